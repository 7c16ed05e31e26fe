"""Benchmark of pipelines, feature profiles and classifiers on a labelled folder of images, by stratified folds.

Features are written once for each pipeline and profile and read by every classifier; a scaler sees the training folds only.
Every learner works on the rows where they lie; no task needs all rows of a combination.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, kernels, learn, metrics, split
from ..sources.images import Manifest
from ..sources.shared import saved
from . import catalog

ORIGINAL = "original"


@dataclass(frozen=True)
class Config:
    pipelines: tuple[str, ...]
    features: tuple[str, ...] = ("combined",)
    classifiers: tuple[str, ...] = tuple(learn.CLASSIFIERS)
    folds: int = 5
    seed: int = 42

    def __post_init__(self) -> None:
        if not (self.pipelines and self.features and self.classifiers):
            raise ValueError("pipelines, features and classifiers must not be empty")
        for kind, names, known in (("feature profile", self.features, features.EXTRACTORS), ("classifier", self.classifiers, learn.CLASSIFIERS)):
            if bad := set(names) - set(known):
                raise ValueError(f"unknown {kind}: {sorted(bad)}")


@dataclass(frozen=True)
class Result:
    """leaderboard, top pipelines, fold metrics, class metrics, matrices, timings, samples with their folds, skipped files (all
    DataFrames) and the number of folds used."""

    leaderboard: DataFrame
    top: DataFrame
    folds: DataFrame
    classes: DataFrame
    matrix: DataFrame
    timings: DataFrame
    assignments: DataFrame
    skipped: DataFrame
    fold_count: int


Runnable = tuple[tuple[catalog.Step, Callable[..., np.ndarray]], ...]


def runnable(pipeline: catalog.Pipeline) -> Runnable:
    """A pipeline's steps with their transforms, looked up where this is called: tasks get the functions, registered ones too."""
    return tuple((s, kernels.REGISTRY[s.transform]) for s in pipeline.steps)


def run_steps(img, steps: Runnable) -> Iterator[tuple[catalog.Step, np.ndarray]]:
    """Each step with the image after it."""
    for step, transform in steps:
        img = transform(kernels.check_image(img), **step.params)
        yield step, img


def run_pipeline(img, steps: Runnable):
    for _, img in run_steps(img, steps):
        pass
    return img


def _extracted(pipeline: catalog.Pipeline | None, profile: str) -> Callable[[np.ndarray], list[dict]]:
    """Features of an image after a pipeline, with the time that each of the two took."""
    extractor, steps = features.EXTRACTORS[profile], runnable(pipeline) if pipeline else ()

    def one(img) -> list[dict]:
        began = time.perf_counter()
        done = run_pipeline(img, steps)
        between = time.perf_counter()
        values = extractor(done).tolist()
        return [{"features": values, "preprocessing_ms": (between - began) * 1000, "feature_extraction_ms": (time.perf_counter() - between) * 1000}]

    return one


KEYS = ("pipeline_id", "feature_profile", "classifier")


def run(spark: SparkSession, manifest: Manifest, config: Config, pipelines: tuple[catalog.Pipeline, ...] = catalog.DEFAULT) -> Result:
    """A classifier's job fits and predicts all folds of a combination together; its times are shared evenly among them."""
    by_id = {p.id: p for p in pipelines}
    if bad := set(config.pipelines) - set(by_id) - {ORIGINAL}:
        raise KeyError(f"unknown pipeline: {sorted(bad)}")
    samples = manifest.samples.select("path", "class_index", "image")
    k = split.fold_count(samples, "class_index", config.folds)
    about = manifest.samples.drop("image")
    assigned = saved(split.stratified_folds(about, "path", "class_index", k, config.seed))
    parts, spent, took = [], [], []
    for pid in config.pipelines:
        for profile in config.features:
            rows = kernels.map_images(samples, ["path", "class_index"], _extracted(by_id.get(pid), profile), "features array<float>, preprocessing_ms double, feature_extraction_ms double")
            rows = saved(rows.join(assigned.select("path", "fold"), "path"))
            spent.append(rows.agg(F.lit(pid).alias("pipeline_id"), F.lit(profile).alias("feature_profile"), F.sum("preprocessing_ms").alias("preprocessing_ms"), F.sum("feature_extraction_ms").alias("feature_extraction_ms")))
            z = learn.standardize(rows.drop("preprocessing_ms", "feature_extraction_ms"))
            for name in config.classifiers:
                began = time.perf_counter()
                found = learn.classifier(name)(z, "path", "class_index", seed=config.seed)
                fitted = time.perf_counter()
                int_ = lambda c: F.col(c).cast("int").alias(c)
                parts.append(saved(found.select(F.lit(pid).alias("pipeline_id"), F.lit(profile).alias("feature_profile"), F.lit(name).alias("classifier"), int_("test_fold").alias("fold"), int_("actual"), int_("predicted"))))
                took.append((pid, profile, name, (fitted - began) * 1000 / k, (time.perf_counter() - fitted) * 1000 / k))
    predictions = reduce(DataFrame.unionByName, parts)
    classes = spark.createDataFrame([(i,) for i in range(len(manifest.class_names))], "class_index int")
    matrix = saved(metrics.confusion(predictions, classes, [*KEYS, "fold"]))
    fit_times = spark.createDataFrame(took, "pipeline_id string, feature_profile string, classifier string, fit_ms double, predict_ms double")
    by_fold = metrics.macro(matrix, [*KEYS, "fold"]).join(F.broadcast(fit_times), list(KEYS))
    timing = saved(reduce(DataFrame.unionByName, spent))
    timings = metrics.mean_timings(by_fold, list(KEYS)).join(F.broadcast(timing), ["pipeline_id", "feature_profile"])
    entries = metrics.over_folds(by_fold, list(KEYS)).join(F.broadcast(timing), ["pipeline_id", "feature_profile"])
    board = metrics.leaderboard(entries.withColumn("total_ms", F.col("preprocessing_ms") + F.col("feature_extraction_ms")))
    return Result(board, metrics.top_pipelines(board), by_fold, metrics.per_class(matrix, [*KEYS, "fold"]), matrix, timings, assigned, manifest.skipped, k)
