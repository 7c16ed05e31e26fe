"""Mixing sources to target weights by hierarchical budgets, native.

A tree of domain, language and source has a weight on each node. A budget of tokens flows down it: at each node it is
shared among the children by weight, no child getting more than its subtree can give (its tokens times `max_epochs`); what
one child can't take goes to its siblings, and only what a whole subtree can't take reaches the ancestors' other children.
A leaf's documents are then taken in seeded order: whole epochs first, then the prefix of the next epoch that its budget
still holds.

Defined results: null languages, sources or domains count as ''; a null text has no tokens and is taken only in whole
epochs or where its place in a prefix costs nothing; rows with the same id are taken alike; an empty table gives an empty
one; further columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, text_or_empty

LEVELS = ("domain", "language", "leaf_source")


@dataclass(frozen=True)
class Mix:
    """Weights of nodes by level and name; a name without one has `default`. `fraction` of all tokens is the target."""

    domain: dict[str, float] = field(default_factory=lambda: {"web": 0.5, "reference": 0.3, "forum": 0.2})
    language: dict[str, float] = field(default_factory=lambda: {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2})
    source: dict[str, float] = field(default_factory=dict)
    default: float = 1.0
    fraction: float = 0.6
    max_epochs: int = 2
    seed: int = 17

    def __post_init__(self) -> None:
        if min([self.default, *self.domain.values(), *self.language.values(), *self.source.values()]) <= 0:
            raise ValueError("weights must be positive")


def domain_of(source: Column) -> Column:
    """The domain that a source belongs to where the corpus has no such column: its name's checksum names one of three."""
    n = F.conv(F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % 3
    return F.when(n == 0, "web").when(n == 1, "reference").otherwise("forum")


def _weight(column: str, weights: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(float(w))).otherwise(out)
    return out


def _share(nodes: DataFrame, parent: list[str], order: str, into: str) -> DataFrame:
    """Shares `budget` of a parent among its nodes (weight, room). In the order of room for a weight, the nodes that can't
    take their share come first; those behind share by weight what these leave."""
    w = W.partitionBy(*parent).orderBy(F.col("room") / F.col("weight"), order)
    before = F.coalesce(F.sum("room").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    behind = F.sum("weight").over(w.rowsBetween(W.currentRow, W.unboundedFollowing))
    own = nodes.withColumn("level", (F.col("budget") - before) / behind).withColumn("short", F.col("room") <= F.col("level") * F.col("weight"))
    left = own.withColumn("given", F.sum(F.when(F.col("short"), F.col("room")).otherwise(0.0)).over(W.partitionBy(*parent))).withColumn(
        "open", F.sum(F.when(F.col("short"), 0.0).otherwise(F.col("weight"))).over(W.partitionBy(*parent))
    )
    return left.withColumn(into, F.when(F.col("short"), F.col("room")).otherwise((F.col("budget") - F.col("given")) / F.col("open") * F.col("weight"))).drop("level", "short", "given", "open", "budget", "room", "weight")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(domain, language, leaf_source, tokens) with `leaf_budget`, in whole tokens. A row for each leaf, no documents."""
    room = leaves.withColumn("leaf_room", (F.col("tokens") * mix.max_epochs).cast("double"))
    sums = lambda keys: room.groupBy(*keys).agg(F.sum("leaf_room").alias("room"))
    total = room.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(mix.fraction)).alias("budget"))
    top = sums(["domain"]).crossJoin(total).withColumn("weight", _weight("domain", mix.domain, mix.default)).withColumn("root", F.lit(0))
    top = _share(top, ["root"], "domain", "b1").drop("root")
    mid = sums(["domain", "language"]).join(top.withColumnRenamed("b1", "budget"), "domain").withColumn("weight", _weight("language", mix.language, mix.default))
    mid = _share(mid, ["domain"], "language", "b2")
    low = room.withColumnRenamed("leaf_room", "room").join(mid.withColumnRenamed("b2", "budget"), ["domain", "language"]).withColumn("weight", _weight("leaf_source", mix.source, mix.default))
    return _share(low, ["domain", "language"], "leaf_source", "b3").withColumn("leaf_budget", F.floor(F.round("b3", 3)).cast("long")).drop("b3")


def mix_sources(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """A row for each document and epoch in which it is taken: `doc` (a struct of the columns `carry`, by default all),
    domain, language, leaf_source, n_tokens, epoch, leaf_budget.

    A leaf may hold any share of the rows: its order is cut into 65,536 ranges of a hash, only sums of ranges are put in order,
    256 at a time, and documents are sorted in none but the one range in which its budget ends. So no task ever holds a leaf."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    keys = list(LEVELS)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("doc"),
        name(domain if domain is not None else domain_of(F.col(source_col))).alias("domain"),
        name(F.col(lang_col)).alias("language"),
        name(F.col(source_col)).alias("leaf_source"),
        F.regexp_count(text_or_empty(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"),
        name(F.col(id_col)).alias("key"),
    )

    def placed(df: DataFrame) -> DataFrame:
        """With its place in the seeded order of the epoch that the leaf takes in part."""
        at = df.withColumn("place", F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("epochs").cast("string"), F.col("key"))))
        return at.withColumn("range", F.conv(F.substring("place", 1, 4), 16, 10).cast("int"))

    light = saved(rows.drop("doc"))
    leaves = saved(light.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")))
    some = lambda c: F.when(F.col("tokens") > 0, c).otherwise(0).cast("long")
    budgets = leaf_budgets(leaves, mix).withColumns({"epochs": some(F.floor(F.col("leaf_budget") / F.greatest("tokens", F.lit(1)))), "rest": some(F.col("leaf_budget") % F.greatest("tokens", F.lit(1)))})
    budgets = saved(budgets.select(*keys, "leaf_budget", "epochs", "rest"))
    sums = saved(placed(light.join(budgets, keys)).groupBy(*keys, "range").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest")).withColumn("block", F.floor(F.col("range") / 256)))
    # The range in which the budget ends: first the block of 256 ranges, then the range in it.
    first = lambda df, place: df.where("upto > rest").groupBy(*keys).agg(F.min(F.struct(place, (F.col("upto") - F.col("n")).alias("before"))).alias("end"))
    blocks = sums.groupBy(*keys, "block").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    blocks = first(blocks.withColumn("upto", F.sum("n").over(W.partitionBy(*keys).orderBy("block"))), "block").select(*keys, F.col("end.block").alias("block"), F.col("end.before").alias("before"))
    inner = sums.join(blocks, [*keys, "block"]).withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy(*keys).orderBy("range")))
    ends = first(inner, "range")
    ends = saved(budgets.join(ends, keys, "left").select(*keys, "leaf_budget", "epochs", "rest", F.coalesce("end.range", F.lit(65536)).alias("end_range"), F.coalesce("end.before", F.lit(0)).alias("before")))

    taken = placed(rows.join(ends, keys))
    sure = taken.withColumn("copies", F.col("epochs") + (F.col("range") < F.col("end_range")).cast("long")).where("copies > 0")
    sure = sure.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    edge = taken.where("range = end_range")
    whole = edge.where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    cum = F.sum("n_tokens").over(W.partitionBy(*keys).orderBy("place", "key"))
    edge = edge.withColumn("upto", F.col("before") + cum).where("upto <= rest").withColumn("epoch", F.col("epochs"))
    out = ["doc", *keys, "n_tokens", "epoch", "leaf_budget"]
    sure = sure.where("range <> end_range")
    return sure.select(*out).unionByName(whole.select(*out)).unionByName(edge.select(*out))


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents that the mix takes, with the columns of `docs`; a document of two epochs comes twice."""
    return mix_sources(docs, mix).select("doc.*")
