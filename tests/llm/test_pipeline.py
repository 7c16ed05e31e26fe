"""The stages and the whole pipeline on a table with nulls in every column, long, empty and repeated texts, and further columns."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from lumenforge.llm import packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxic_score double, body string, `a.b` int"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    texts = [words(rng, rng.randint(6, 90)) + (" idiot loser stupid" if i % 6 == 0 else "") for i in range(90)]
    texts += [None, "", " \n", texts[1], texts[1] + " ", texts[2] + " end", words(rng, 30_000)]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None if i % 2 else 3, None if i % 3 else 0.9, "x", None if i % 4 else 1) for i, t in enumerate(texts)]
    rows += [(None, words(rng, 12), None, None, None, None, None, None), (3, texts[3], "en", "s0", 1, 0.1, "y", 2)]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(i % 6 == 0)) for i in range(90)] + [(None, 1), (5, None)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns, name
        kept = after.collect()
        assert {tuple(r) for r in kept} <= {tuple(r) for r in before}, name
        if name == "toxicity":
            gone = {r.doc_id for r in before} - {r.doc_id for r in kept}
            assert gone == {i for i in range(90) if i % 6 == 0}
        if name == "exact_dedup":
            norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept]
            assert len(set(norm)) == len(norm) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in before})
        docs = spark.createDataFrame(kept, docs.schema)
    assert docs.count() > 10


def test_run(spark, folder):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    pieces = corpus_pipeline.run(spark, folder).collect()
    by = {}
    for r in pieces:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by) > 10
    for key, own in by.items():
        if key is not None:
            got = b"".join(bytes(r.ids) for r in sorted(own, key=lambda r: r.start))
            assert np.frombuffer(got, "<u4").tolist() == [*tok.encode(text[key], add_special_tokens=False).ids, 2]
    lengths = {}
    for r in pieces:
        lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in lengths.values())


def test_empty(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
