"""Classification metrics as aggregations: dense confusion matrices, per-class and macro figures, folds, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def class_grid(classes: DataFrame, entries: DataFrame) -> DataFrame:
    """Every (entry, actual, predicted); both sides are a few rows."""
    one = classes.select(F.col("class_index").alias("actual"))
    return entries.crossJoin(F.broadcast(one.crossJoin(one.withColumnRenamed("actual", "predicted"))))


def confusion(predictions: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, actual, predicted, n), dense: pairs of classes that don't occur have 0."""
    counts = predictions.groupBy(*keys, "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    grid = class_grid(classes, counts.select(*keys).distinct())
    return grid.join(counts, [*keys, "actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / F.greatest(b, F.lit(1)))


def per_class(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, class_index, precision, recall, f1, support) for every class."""
    n, hit = F.col("n"), F.col("actual") == F.col("predicted")
    both = matrix.select(*keys, F.explode(F.array(F.struct(F.col("actual").alias("c"), F.lit(True).alias("row")), F.struct(F.col("predicted").alias("c"), F.lit(False).alias("row")))).alias("x"), n, hit.alias("hit"))
    sums = both.groupBy(*keys, F.col("x.c").alias("class_index")).agg(
        F.sum(F.when(F.col("x.row") & F.col("hit"), n).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("x.row"), n).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("x.row"), n).otherwise(0)).alias("called"),
    )
    p, r = _ratio(F.col("tp"), F.col("called")), _ratio(F.col("tp"), F.col("support"))
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.greatest(p + r, F.lit(1e-12)))
    return sums.select(*keys, "class_index", p.alias("precision"), r.alias("recall"), f1.alias("f1"), "support")


def macro(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, accuracy, macro_precision, macro_recall, macro_f1): unweighted means over all classes."""
    means = per_class(matrix, keys).groupBy(*keys).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    acc = matrix.groupBy(*keys).agg(_ratio(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    return acc.join(means, keys)


def over_folds(folds: DataFrame, keys: list[str]) -> DataFrame:
    """Means and sample deviations of fold values; one fold has deviation 0."""
    spread = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    return folds.groupBy(*keys).agg(
        F.avg("accuracy").alias("mean_accuracy"), spread("accuracy").alias("std_accuracy"), F.avg("macro_f1").alias("mean_macro_f1"), spread("macro_f1").alias("std_macro_f1"),
        F.avg("macro_precision").alias("mean_macro_precision"), F.avg("macro_recall").alias("mean_macro_recall"),
    )


def mean_timings(folds: DataFrame, keys: list[str]) -> DataFrame:
    return folds.groupBy(*keys).agg(F.avg("fit_ms").alias("mean_fit_ms"), F.avg("predict_ms").alias("mean_predict_ms"))


def leaderboard(entries: DataFrame) -> DataFrame:
    """Entries (pipeline_id, feature_profile, classifier, means, total_ms) with their rank. There is a row for each combination,
    of which a run has as many as it was told to fit: one task sorts them."""
    w = W.orderBy(F.desc(F.round("mean_macro_f1", 6)), F.desc(F.round("mean_accuracy", 6)), "total_ms", "pipeline_id", "feature_profile", "classifier")
    return entries.withColumn("rank", F.row_number().over(w))


def top_pipelines(board: DataFrame, n: int = 3) -> DataFrame:
    """The best entry of each pipeline, the n best of these."""
    first = board.withColumn("own", F.row_number().over(W.partitionBy("pipeline_id").orderBy("rank"))).where("own = 1").drop("own")
    return first.orderBy("rank").limit(n)


def positions(board: DataFrame, top: DataFrame) -> DataFrame:
    """Entries of the leaderboard that stand in `top`, with their place there, by a join on the three names of an entry."""
    keys = ["pipeline_id", "feature_profile", "classifier"]
    return board.join(F.broadcast(top.select(*keys, F.col("rank").alias("top_rank"))), keys).orderBy("rank")
