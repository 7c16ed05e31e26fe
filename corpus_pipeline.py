"""A corpus made ready for training: toxic documents and copies go, sources are mixed to weights, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. A stage's result is written in the
shared folder and read again as the next one's documents, so a lost executor costs no more than its own stage. Tables that a
stage wrote on the way are removed when its result stands.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from lumenforge.llm.common import table
from lumenforge.sources.shared import settled

TOXIC = 0.3
#: The mix of op10 without second epochs: copies that two stages have removed don't come back.
MIX = mixing.Mix(max_epochs=1)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below TOXIC."""
    own = f"toxic_{uuid.uuid4().hex}"
    return toxicity.with_scores(docs, table(spark, sf_dir, "labels"), into=own).where(F.col(own) < TOXIC).drop(own)


def exact_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-word shingle sets that are similar to 0.8 or more."""
    return jaccard_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, MIX)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxic_out), ("exact_dedup", exact_copies_out), ("jaccard_join", near_copies_out), ("mixing", mixed), ("packing", packed)]

#: A learned score and a tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(spark, lambda docs=docs, stage=stage: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
