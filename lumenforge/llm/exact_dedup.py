"""Exact dedup, native: 128-bit content hashes group the texts, bytes are compared inside the groups, the smallest id stays.

Defined results: a null text counts as empty; an empty table gives an empty result; rows that repeat an id are rows of
their own (each counts in group_size, all with the smallest id are marked kept); a null id never wins against another and
a group of null ids only keeps them all; further columns are ignored by `exact_groups` and kept by `drop_exact_copies`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_space, saved, text_or_empty


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), one_space(text_or_empty(text_col)).alias("body"))


def _copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row (h, sha, keep_id, group_size) for each text that more than one row has.

    Grouping by hash and text compares the bytes of whatever shares a hash, so two texts never meet in one group. Map-side
    aggregation leaves one row for each text and task, however large a group of copies is."""
    return (
        _hashed(docs, id_col, text_col)
        .groupBy(F.unhex(F.md5("body")).alias("h"), "body")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("h", F.unhex(F.sha2("body", 256)).alias("sha"), "keep_id", "group_size")
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256.

    Only ids and hashes are joined back; the table of groups is written first, so both sides of that join are plain
    exchanges, of which AQE splits a hot group (or it broadcasts the table where its measured size allows)."""
    groups = saved(_copies(docs, id_col, text_col))
    rows = _hashed(docs, id_col, text_col).select("id", F.unhex(F.md5("body")).alias("h"), F.unhex(F.sha2("body", 256)).alias("sha"))
    out = rows.join(groups, ["h", "sha"], "left")
    one = F.col("group_size").isNull()
    keep = F.when(one, F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with all its columns: of equal texts one row, with the smallest id (of rows that repeat it, the least in the
    order of the columns; a column of maps has no order and does not count).

    One exchange: rows travel once, grouped by hash and text as in `_copies`, each task sending one row for a text. A text
    that is its own normal form is not sent a second time."""
    body = one_space(text_or_empty(text_col))
    field = lambda c: F.col(f"`{c}`")
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    loose = [c for c in rest if re.search("map<|variant", docs.schema[c].dataType.simpleString())]
    ordered = [c for c in rest if c not in loose]
    raw = F.when(~field(text_col).eqNullSafe(body), F.struct(field(text_col).alias("text")))
    numbered = lambda columns: F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    order = numbered([field(id_col).isNull(), field(id_col), *map(field, ordered), raw])
    rows = docs.select(body.alias("body"), order.alias("row"), numbered([F.lit(0), *map(field, loose)]).alias("loose"))
    first = rows.groupBy(F.unhex(F.md5("body")).alias("h"), "body").agg(F.min("row").alias("row"), *([F.min_by("loose", "row").alias("loose")] if loose else []))
    place = {c: F.col("row").getField(f"c{i}") for i, c in enumerate([id_col, *ordered], 1)}
    place |= {c: F.col("loose").getField(f"c{i}") for i, c in enumerate(loose, 1)}
    place[text_col] = F.coalesce(F.col("row").getField(f"c{len(ordered) + 2}"), F.struct(F.col("body").alias("text"))).getField("text")
    return first.select(*[place[c].alias(c) for c in docs.columns])
