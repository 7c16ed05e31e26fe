import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from lumenforge import __main__ as cli
from lumenforge.operators import diagnostics, learn
from lumenforge.plans import advisor, benchmark, catalog, catalogue, reports
from lumenforge.sources import images
from lumenforge.streaming import drop_folder


@pytest.fixture(scope="module")
def shapes(tmp_path_factory):
    root = tmp_path_factory.mktemp("shapes")
    y, x = np.mgrid[:32, :32]
    for name, mask in (("circle", (y - 16) ** 2 + (x - 16) ** 2 < 80), ("square", (abs(y - 16) < 12) & (abs(x - 16) < 12))):
        (root / name).mkdir()
        for i in range(6):
            (root / name / f"{i}.png").write_bytes(images.encode_png(np.where(mask[..., None], 200 + i, 60 + 2 * i).repeat(3, axis=2).astype(np.uint8)))
    return root


def test_advice(spark, shapes):
    found = images.discover(spark, str(shapes)).samples.limit(2)
    rows = advisor.advise(found, "color").collect()
    assert len(rows) == 6 and {r.rank for r in rows} == {1, 2, 3} and all(0 <= r.score <= 100 and len(r.reasons) == 2 for r in rows)
    with pytest.raises(ValueError):
        advisor.advise(found, "none")


def test_benchmark(spark, shapes):
    config = benchmark.Config(("original", "baseline-normalize"), ("color",), ("knn", "svm"), folds=3)
    result = benchmark.run(spark, images.discover(spark, str(shapes)), config)
    board = result.leaderboard.orderBy("rank").collect()
    assert len(board) == 4 and [r.rank for r in board] == [1, 2, 3, 4] and result.fold_count == 3
    assert result.top.count() == 2 and result.folds.count() == 12 and result.matrix.count() == 48
    with pytest.raises(ValueError):
        benchmark.Config(("original",), (), ("knn",))


def test_command_line(spark, shapes, tmp_path, capsys):
    assert cli.main(["analyze-image", "--image", str(shapes / "circle" / "0.png"), "--output", str(tmp_path)]) == 0
    at = capsys.readouterr().out.strip().splitlines()[-1]
    assert spark.read.option("header", "true").csv(f"{at}/recommendations.csv").count() == 3
    assert spark.read.option("header", "true").csv(f"{at}/metric_changes.csv").count() == 3 * 13
    assert cli.main(["analyze-image", "--image", str(shapes / "none.png"), "--output", str(tmp_path)]) == 2
    assert cli.main(["benchmark", "--dataset", str(shapes), "--classifiers", "", "--output", str(tmp_path)]) == 2


def test_report_is_whole_or_gone(spark, shapes, tmp_path):
    at = reports.write_advice(images.discover(spark, str(shapes)).samples.limit(2), "shape", str(tmp_path / "a"), bom=True)
    raw = next(p for p in (tmp_path / "a").glob("*/diagnostics.csv/part-*")).read_bytes()
    assert raw.startswith("\ufeffpath".encode())
    rows = spark.read.json(f"{at}/recommendations.json").collect()
    assert len(rows) == 2 and all(r.profile == "shape" and len(r.recommendations) == 3 and len(r.recommendations[0].metric_changes) == 13 and r.pipeline_config_hash for r in rows)
    diagnostics = spark.read.option("header", "true").csv(f"{at}/diagnostics.csv")
    assert diagnostics.count() == 8 and sorted(r.scope for r in diagnostics.collect())[:2] == ["original"] * 2
    steps = spark.read.parquet(f"{at}/steps")
    assert steps.count() >= 6 and images.decode_image(bytes(steps.first().png)).shape == (32, 32, 3)
    names = reports.write_step_files(spark, at, rows[0].path)
    with zipfile.ZipFile(io.BytesIO(reports.report_zip(spark, at))) as z:
        assert set(names) <= set(z.namelist()) and "run.json" in z.namelist()
    with pytest.raises(ValueError):
        reports.report_zip(spark, at, most=10)
    with pytest.raises(RuntimeError), reports.report(spark, str(tmp_path / "b")) as (staged, _):
        spark.range(1).write.csv(f"{staged}/x.csv")
        raise RuntimeError
    assert not list((tmp_path / "b").glob("*")) and not list((tmp_path / "b").glob(".*part"))


def test_benchmark_report(spark, shapes, tmp_path):
    (shapes / "circle" / "bad.png").write_bytes(b"no image")
    manifest = images.discover(spark, str(shapes))
    result = benchmark.run(spark, manifest, benchmark.Config(("original",), ("color",), ("knn",), folds=2))
    at = reports.write_benchmark(result, manifest.class_names, str(tmp_path), seed=42)
    read = lambda n: spark.read.option("header", "true").csv(f"{at}/{n}.csv")
    assert {"preprocessing_ms", "feature_extraction_ms", "mean_fit_ms", "mean_predict_ms"} <= set(read("timings").columns) and {"fit_ms", "predict_ms"} <= set(read("fold_metrics").columns)
    assert {"preprocessing_ms", "feature_extraction_ms"} <= set(read("leaderboard").columns)
    assert read("samples").count() == 12 and {r.fold for r in read("samples").collect()} == {"0", "1"} and [r.reason for r in read("skipped").collect()] == ["unreadable image"]
    (shapes / "circle" / "bad.png").unlink()
    (shapes / "empty").mkdir()
    with pytest.raises(ValueError, match="class empty has 0"):
        images.discover(spark, str(shapes))
    (shapes / "empty").rmdir()


def test_self_check(tmp_path, capsys):
    assert cli.main(["self-check", "--output", str(tmp_path)]) == 0 and "SELF-CHECK PASSED" in capsys.readouterr().out


def test_a_further_classifier(spark):
    learn.register("first", lambda rows, key, label, seed: rows.where("fold = test_fold").select("test_fold", key, F.col(label).alias("actual"), F.lit(0).alias("predicted")))
    assert "first" in learn.CLASSIFIERS and benchmark.Config(("original",), ("color",), ("first",))
    with pytest.raises(ValueError):
        learn.register("knn", None)
    with pytest.raises(ValueError):
        learn.classifier("none")
    del learn.CLASSIFIERS["first"]


def test_advice_is_that_of_the_kernels(spark):
    """Scores of every image and pipeline against plain arithmetic on the measured figures."""
    rows = catalogue._as_images(spark, SF).withColumnRenamed("image_id", "path").limit(6)
    found = advisor.measured(rows, "texture")
    told = {(r.path, r["rank"]): r for r in advisor.recommend(found, "texture").collect()}
    clip = lambda v: max(0.0, min(100.0, v))
    better = lambda b, a, k: clip(50 + (a - b) / max(abs(b), 1e-9) * k)
    by = {}
    for r in found.collect():
        b, a = ({m: r[f"{s}_{m}"] for m in diagnostics.METRICS} for s in ("before", "after"))
        clips = lambda x: x["dark_clip_ratio"] + x["bright_clip_ratio"]
        many = a["edge_density"] > max(0.25, b["edge_density"] * 2.5)
        parts = {"local_contrast": better(b["local_contrast"], a["local_contrast"], 50), "sharpness": better(b["sharpness"], a["sharpness"], 35), "entropy": better(b["entropy"], a["entropy"], 40), "edge_density": better(b["edge_density"], a["edge_density"], 35) / (2 if many else 1), "noise_reduction": better(b["noise_estimate"], 2 * b["noise_estimate"] - a["noise_estimate"], 50), "clipping_control": clip(100 - 500 * clips(a))}
        score = sum(parts[m] * w for m, w in catalog.WEIGHTS["texture"].items())
        warned = [k for k, so in (("clipping", clips(a) - clips(b) > 0.01 or clips(a) > 0.05), ("excessive_edges", many), ("oversmoothing", b["sharpness"] > 1e-9 and a["sharpness"] < b["sharpness"] / 2), ("color_loss", b["colorfulness"] > 1e-9 and a["colorfulness"] < b["colorfulness"] / 2)) if so]
        by.setdefault(r.path, []).append((-round(score, 6), len(warned), r.processing_ms, r.pipeline_id, warned))
    for path, rows in by.items():
        assert len(rows) == 9
        for i, (score, _, _, name, warned) in enumerate(sorted(rows)[:3], 1):
            r = told[path, i]
            assert (r.pipeline_id, r.warnings) == (name, warned) and abs(r.score + score) < 1e-5


def test_drop_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pgm").write_bytes(b"P5\n4 2\n255\n" + bytes([0, 0, 255, 255, 100, 100, 100, 100]))
    where = [str(tmp_path / x) for x in ("in", "out", "state")]
    drop_folder.run_once(spark, *where)
    (tmp_path / "in" / "b.pgm").write_bytes(b"P5\n1 1\n255\n\x07")
    drop_folder.run_once(spark, *where)
    rows = {r.path[-5:]: r for r in spark.read.parquet(where[1]).collect()}
    assert rows["a.pgm"].mean_brightness == 113.75 and rows["a.pgm"].entropy == 1.5 and rows["b.pgm"].mean_brightness == 7 and len(rows) == 2


def test_tables_of_a_step_go_when_its_result_stands(spark):
    from lumenforge.sources import shared

    start = shared.written()
    first = shared.saved(spark.range(5))
    out = shared.settled(spark, lambda: shared.saved(shared.saved(first).where("id > 1")))
    paths = shared._WRITTEN[start:]
    assert shared.written() == start + 2 and out.count() == 3 and first.count() == 5
    shared.release(spark, start)
    assert shared.written() == start and not any(shared.Folder(spark, p).exists() for p in paths)
