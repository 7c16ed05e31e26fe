"""Secret scans, native: candidates by pattern, then how many distinct repositories and owners hold each one.

A value that many owners hold is an example copied from a manual; one that a single owner holds looks live. Base kinds
are assign, access and hex; the method adds `github`, `slack`, `jwt` and `pem`.

Defined results: a null text is empty; a null repository or owner counts as the name ''; rows with the same id stay rows
of their own; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, text_or_empty

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "slack", "jwt", "pem")
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind: pattern. For access and hex the least length stands in the pattern: what fails it holds no longer match inside.
PATTERNS = {
    "assign": _ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "jwt": r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
#: kind: a string without which there is no match, so most texts skip the pattern.
_HINT = {"access": "AKIA", "github": "gh", "slack": "xox", "jwt": "eyJ", "pem": "-----BEGIN "}


def _matches(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, value>> of a pattern's leftmost non-overlapping matches, in code points. The parts
    between the matches and the matches themselves, in turn, add up to the places."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>").alias("out"))
    value = (lambda hit: F.regexp_extract(hit, f"^{pattern}", 2)) if kind == "assign" else (lambda hit: hit)

    def step(acc: Column, x: Column) -> Column:
        a = acc.at + F.length(x.gap)
        b = a + F.length(x.hit)
        one = F.struct(F.lit(kind).alias("kind"), a.cast("long").alias("start"), b.cast("long").alias("end"), value(x.hit).alias("value"))
        return F.struct(b.cast("long").alias("at"), F.concat(acc.out, F.array(one)).alias("out"))

    spans = F.aggregate(pairs, start, step, lambda acc: acc.out)
    if kind == "assign":
        spans = F.filter(spans, lambda s: F.length(s.value) >= 6)
    may = text.contains(_HINT[kind]) if kind in _HINT else text.rlike(pattern)
    return F.when(may, spans).otherwise(start.getField("out"))


def scan(docs: DataFrame, id_col: str, text_col: str, repo: Column, owner: Column) -> DataFrame:
    """id, repo, owner and all candidate spans by start, then kind."""
    text = F.col("__text")
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(repo, F.lit("")).alias("repo"), F.coalesce(owner, F.lit("")).alias("owner"), text_or_empty(text_col).alias("__text"))
    spans = F.concat(*[_matches(text, k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.start, rank[s.kind].alias("rank"), s.kind, s.end, s.value)))
    return keyed.select("id", "repo", "owner", ordered.alias("spans"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None, copied_from: int = 3) -> DataFrame:
    """One row per document: id, spans array<struct<start, rank, kind, end, value>>, n_live and n_copied (its distinct
    candidates that fewer than, or at least, `copied_from` owners hold), most_owners, most_repos.

    The texts are read once; candidates are counted in two steps, distinct (hash, repository, owner) and then by hash,
    each combined before its shuffle, so a value that everyone holds is a row for each owner at most."""
    repo = F.lit("") if repo is None else repo
    owner = F.lit("") if owner is None else owner
    rows = saved(scan(docs, id_col, text_col, repo, owner).withColumn("row", F.monotonically_increasing_id()))
    held = (
        rows.where(F.size("spans") > 0)
        .select("row", "repo", "owner", F.explode(F.array_distinct(F.transform("spans", lambda s: F.unhex(F.sha2(s.value, 256))))).alias("hash"))
    )
    by_owner = held.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    freq = by_owner.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos")).groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))
    seen = held.select("row", "hash").join(saved(freq), "hash").groupBy("row").agg(
        F.count(F.when(F.col("owners") < copied_from, 1)).alias("n_live"), F.count(F.when(F.col("owners") >= copied_from, 1)).alias("n_copied"), F.max("owners").alias("most_owners"), F.max("repos").alias("most_repos")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(seen, "row", "left").select(F.col("id").alias(id_col), "spans", *[zero(c) for c in ("n_live", "n_copied", "most_owners", "most_repos")])
