"""Reports: one folder for a run, its tables written by Spark, its settings as JSON.

A report is written below a hidden name and renamed when all of it stands, so a folder with its final name is whole; if
anything fails, what was written goes away. Names are handled by Hadoop's file system: any store that Spark writes will do.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..sources.shared import Folder
from . import advisor, benchmark, catalog

BOM = "﻿"
MOST_ZIPPED = 1 << 28


@contextmanager
def report(spark: SparkSession, out: str) -> Iterator[tuple[str, str]]:
    """(where to write, where it will stand): a new folder by time and chance below `out`."""
    name = f"{datetime.now(UTC):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"
    folder, staged, root = Folder(spark, out), f".{name}.part", out.rstrip("/")
    try:
        yield f"{root}/{staged}", f"{root}/{name}"
        folder.rename(staged, name)
    except BaseException:
        folder.delete(staged)
        raise


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """Arrays and structs as JSON, since CSV has none. With `bom`, each file starts with a byte order mark, for spreadsheets."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct")) else F.col(c) for c, t in df.dtypes]
    out = df.select(*flat)
    if bom:
        out = out.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    out.write.option("header", "true").option("encoding", "UTF-8").csv(path)


def config_hash(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()


def _write_json(spark: SparkSession, at: str, name: str, **values) -> None:
    Folder(spark, at).write(name, json.dumps(values, sort_keys=True, indent=2, ensure_ascii=False).encode())


def engine_version(spark: SparkSession) -> str:
    """What has computed a report."""
    return f"lumenforge {__version__}, spark {spark.version}, numpy {np.__version__}"


def advice_documents(advice: DataFrame, found: DataFrame, pipelines: tuple[catalog.Pipeline, ...] = catalog.DEFAULT, **metadata) -> DataFrame:
    """A document for each image: metadata, then its recommendations with their names, parts and changes of metrics."""
    languages = sorted({"en"}.union(*[p.names for p in pipelines]))
    named = [(p.id, *[p.display_name(x) for x in languages]) for p in pipelines]
    shown = F.broadcast(advice.sparkSession.createDataFrame(named, "pipeline_id string, " + ", ".join(f"display_name_{x} string" for x in languages)))
    changes = advisor.metric_changes(found).groupBy("path", "pipeline_id").agg(F.collect_list(F.struct("metric", "before", "after", "absolute_delta", "percent_delta")).alias("metric_changes"))
    rows = advice.join(changes, ["path", "pipeline_id"]).join(shown, "pipeline_id", "left")
    every = F.array_sort(F.collect_list(F.struct("rank", "pipeline_id", *[f"display_name_{x}" for x in languages], "score", "reasons", "warnings", "processing_ms", F.col("parts").alias("score_components"), "metric_changes")))
    return rows.groupBy("path").agg(every.alias("recommendations")).select(*[F.lit(str(v)).alias(k) for k, v in metadata.items()], "path", "recommendations")


def write_advice(images: DataFrame, profile: str, out: str, limit: int = 3, pipelines: tuple[catalog.Pipeline, ...] = catalog.DEFAULT, bom: bool = False, **settings) -> str:
    """Advice on `images` with all that belongs to it; the images are measured once."""
    spark = images.sparkSession
    found = advisor.measured(images, profile, pipelines)
    advice = advisor.recommend(found, profile, limit)
    about = {"generated_at": datetime.now(UTC).isoformat(), "engine_version": engine_version(spark), "profile": profile, "pipeline_config_hash": config_hash([asdict(p) for p in pipelines]), "scoring_config_hash": config_hash(catalog.WEIGHTS)}
    with report(spark, out) as (at, final):
        write_csv(advisor.diagnostics_rows(found, advice).orderBy("path", "scope"), f"{at}/diagnostics.csv", bom)
        write_csv(advice.select("path", "rank", "pipeline_id").join(advisor.metric_changes(found), ["path", "pipeline_id"]), f"{at}/metric_changes.csv", bom)
        write_csv(advice, f"{at}/recommendations.csv", bom)
        advice_documents(advice, found, pipelines, **about).write.json(f"{at}/recommendations.json")
        advisor.steps(images, advice, pipelines).write.parquet(f"{at}/steps")
        _write_json(spark, at, "run.json", kind="advice", **about, **settings)
    return final


def write_step_files(spark: SparkSession, at: str, path: str) -> list[str]:
    """steps/<pipeline>/<nn>_<step>.png of one image of a report."""
    folder, out = Folder(spark, at), []
    for r in spark.read.parquet(f"{at}/steps").where(F.col("path") == path).orderBy("pipeline_id", "step_no").toLocalIterator():
        out.append(f"step_files/{r.pipeline_id}/{r.step_no:02d}_{r.transform}.png")
        folder.write(out[-1], bytes(r.png))
    return out


def write_benchmark(result: benchmark.Result, class_names: list[str], out: str, bom: bool = False, **settings) -> str:
    spark = result.leaderboard.sparkSession
    names = spark.createDataFrame(list(enumerate(class_names)), "class_index int, class_name string")
    tables = {
        "leaderboard": result.leaderboard.orderBy("rank"), "top_pipelines": result.top, "fold_metrics": result.folds, "class_metrics": result.classes.join(F.broadcast(names), "class_index"),
        "timings": result.timings, "confusion": result.matrix.groupBy("pipeline_id", "feature_profile", "classifier", "actual", "predicted").agg(F.sum("n").alias("n")),
        "samples": result.assignments, "skipped": result.skipped,
    }
    with report(spark, out) as (at, final):
        for name, df in tables.items():
            write_csv(df, f"{at}/{name}.csv", bom)
        _write_json(spark, at, "run_config.json", kind="benchmark", generated_at=datetime.now(UTC).isoformat(), actual_folds=result.fold_count, class_names=class_names, sample_count=result.assignments.count(), skipped_count=result.skipped.count(), **settings)
    return final


def report_zip(spark: SparkSession, at: str, most: int = MOST_ZIPPED) -> bytes:
    """A report, or a folder in it, as a ZIP of its files by their relative names. Refused beyond `most` bytes."""
    folder = Folder(spark, at)
    files = [(name, size) for name, size in folder.files() if not name.rpartition("/")[2].startswith((".", "_"))]
    if sum(size for _, size in files) > most:
        raise ValueError(f"the report holds more than {most} bytes")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name, _ in files:
            z.writestr(name, folder.read(name))
    return data.getvalue()
