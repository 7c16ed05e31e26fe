"""Exact percentiles of groups of any size: order statistics by rounds of counts between cuts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved

#: Rows of a group among which a rank is looked up at last, and cuts of a round.
FEW, CUTS = 2048, 64


def _same(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on columns that may be null; those of `a` are kept."""
    other = b.withColumnsRenamed({c: f"{c}_of_other" for c in on})
    match: Column = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}_of_other")) for c in on])
    return a.join(other, match, how).drop(*[f"{c}_of_other" for c in on])


def ranks(rows: DataFrame, group: list[str], wanted: DataFrame) -> DataFrame:
    """(group, rank, value) for `wanted` (group, rank from 0, low, high: bounds of the group's values, live: their number), from
    `rows` (group, value), a written table.

    In a round, the values between a rank's bounds are counted between cuts that percentile_approx finds (a sketch of fixed
    size), and the bounds close in on those cuts between which the rank lies. Rounds end when a value or FEW rows are left, so no
    task holds more of a group."""
    by = [*group, "rank"]
    state = saved(wanted.select(*by, "low", "high", "live", F.lit(0).cast("long").alias("below")))
    done = []
    while True:
        open_ = (F.col("low") < F.col("high")) & (F.col("live") > FEW)
        done.append(state.where(~open_))
        state = state.where(open_)
        if state.isEmpty():
            break
        live = _same(rows, state, group).where("value >= low and value <= high")
        probs = [i / CUTS for i in range(1, CUTS)]
        cuts = saved(live.groupBy(*by).agg(F.array_distinct(F.percentile_approx("value", probs, 20 * CUTS)).alias("cuts")))
        counted = _same(live, cuts, by).withColumn("part", F.size(F.filter("cuts", lambda c: c <= F.col("value"))))
        parts = counted.groupBy(*by, "part", "below").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        # CUTS parts of a rank at most, as one sorted array in its row.
        held = parts.groupBy(*by, "below").agg(F.array_sort(F.collect_list(F.struct("part", "n", "low", "high"))).alias("parts"))
        start = F.struct(F.col("below").alias("upto"), F.lit(None).cast("struct<low:double,high:double,live:bigint,below:bigint>").alias("found"))

        def step(acc: Column, p: Column) -> Column:
            hit = F.struct(p.low.alias("low"), p.high.alias("high"), p.n.alias("live"), acc.upto.alias("below"))
            return F.struct((acc.upto + p.n).alias("upto"), F.when(acc.found.isNull() & (acc.upto + p.n > F.col("rank")), hit).otherwise(acc.found).alias("found"))

        state = saved(held.select(*by, F.aggregate("parts", start, step).found.alias("found")).select(*by, "found.*"))
    ended = saved(reduce(DataFrame.unionByName, done))
    some = _same(rows, ended.where("low < high"), group).where("value >= low and value <= high")
    looked = some.groupBy(*by, "below").agg(F.array_sort(F.collect_list("value")).alias("held")).select(*by, F.get("held", (F.col("rank") - F.col("below")).cast("int")).alias("value"))
    return ended.where("not low < high").select(*by, F.col("low").alias("value")).unionByName(looked)


def percentiles(rows: DataFrame, group: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """(group, share, percentile): between the two nearest values in proportion. Null values don't count; a group without others has no
    row."""
    if not shares or not all(0 <= p <= 1 for p in shares):
        raise ValueError("shares lie between 0 and 1")
    own = saved(rows.select(*group, F.col(value).cast("double").alias("value")).where("value is not null"))
    sizes = own.groupBy(*group).agg(F.count(F.lit(1)).alias("live"), F.min("value").alias("low"), F.max("value").alias("high"))
    asked = saved(sizes.select("*", F.explode(F.array(*map(F.lit, map(float, shares)))).alias("share")).withColumn("place", F.col("share") * (F.col("live") - 1)))
    ends = F.array_distinct(F.array(F.floor("place"), F.ceil("place")))
    found = saved(ranks(own, group, asked.select(*group, "low", "high", "live", F.explode(ends).alias("rank")).distinct()))
    at = lambda name, f: found.select(*group, F.col("rank").alias(f), F.col("value").alias(name))
    asked = asked.withColumns({"floor": F.floor("place"), "ceil": F.ceil("place")})
    both = _same(_same(asked, at("lower", "floor"), [*group, "floor"]), at("upper", "ceil"), [*group, "ceil"])
    return both.select(*group, "share", (F.col("lower") + (F.col("upper") - F.col("lower")) * (F.col("place") - F.col("floor"))).alias("percentile"))
