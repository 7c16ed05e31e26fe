"""Command line: analyze-image, benchmark, self-check. Exit codes: 0 done, 2 bad input, 1 anything else."""

from __future__ import annotations

import argparse
import sys
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenforge")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze-image")
    a.add_argument("--image", required=True)
    a.add_argument("--profile", default="auto", choices=("auto", "shape", "color", "texture"))
    a.add_argument("--output", default="outputs")
    b = sub.add_parser("benchmark")
    b.add_argument("--dataset", required=True)
    b.add_argument("--folds", type=int, default=5)
    b.add_argument("--pipelines", default="original,lab-clahe,clahe-bilateral")
    b.add_argument("--features", default="combined")
    b.add_argument("--classifiers", default="svm,knn,rtrees")
    b.add_argument("--seed", type=int, default=42)
    b.add_argument("--output", default="outputs")
    c = sub.add_parser("self-check")
    c.add_argument("--output")
    return p


def _names(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(",") if x.strip())


def analyze(spark: SparkSession, image: str, profile: str, output: str) -> str:
    from .plans import advisor, reports
    from .sources import images

    found = images.as_colour(images.scan(spark, image).where("image.height > 0"))
    if not found.take(1):
        raise ValueError(f"no readable image: {image}")
    return reports.write_advice(found.where(images.valid()), profile, output, image=image)


def bench(spark: SparkSession, a: argparse.Namespace) -> str:
    from .plans import benchmark, reports
    from .sources import images

    manifest = images.discover(spark, a.dataset)
    config = benchmark.Config(_names(a.pipelines), _names(a.features), _names(a.classifiers), a.folds, a.seed)
    return reports.write_benchmark(benchmark.run(spark, manifest, config), manifest.class_names, a.output, seed=a.seed, requested_folds=a.folds, dataset=a.dataset, pipelines=config.pipelines, features=config.features, classifiers=config.classifiers)


def self_check(spark: SparkSession, output: str | None) -> None:
    """Advice on a gradient and a benchmark of two classes of shapes; what both have written is read again."""
    from .plans import catalog
    from .sources import images, samples
    from .sources.shared import Folder

    root = Path(tempfile.mkdtemp(prefix="self-check-"))
    out = output or str(root / "out")
    (root / "low_contrast.png").write_bytes(images.encode_png(samples.ramp()))
    data = samples.shapes(root / "classification")
    catalog.check_catalog(catalog.DEFAULT)
    catalog.check_weights(catalog.WEIGHTS)
    advice = analyze(spark, str(root / "low_contrast.png"), "auto", out)
    board = bench(spark, parser().parse_args(["benchmark", "--dataset", str(data), "--folds", "3", "--pipelines", "original,lab-clahe", "--features", "color", "--classifiers", "svm,knn", "--output", out]))
    read = lambda at, name: spark.read.option("header", "true").csv(f"{at}/{name}.csv")
    told = {"recommendations": (read(advice, "recommendations").count(), 3), "diagnostics": (read(advice, "diagnostics").count(), 4), "leaderboard": (read(board, "leaderboard").count(), 4), "timings": (read(board, "timings").count(), 4), "samples": (read(board, "samples").count(), 12)}
    if wrong := {k: v for k, v in told.items() if v[0] != v[1]}:
        raise RuntimeError(f"rows found and expected: {wrong}")
    if not Folder(spark, advice).exists("run.json") or not Folder(spark, board).exists("run_config.json"):
        raise RuntimeError("a report lacks its settings")
    print("SELF-CHECK PASSED")


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        spark = SparkSession.builder.appName("lumenforge").getOrCreate()
        if a.command == "analyze-image":
            print(analyze(spark, a.image, a.profile, a.output))
        elif a.command == "benchmark":
            print(bench(spark, a))
        else:
            self_check(spark, a.output)
    except (FileNotFoundError, ValueError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except Exception as e:
        print(f"failed: {e}", file=sys.stderr)
        return 1
    return 0


def run() -> None:
    sys.exit(main())


if __name__ == "__main__":
    run()
