import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenforge.operators import diagnostics, features, kernels, learn, metrics, scoring, split, transforms
from lumenforge.plans import catalog
from lumenforge.sources import images, rasters


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(1).integers(0, 256, (40, 48, 3)).astype(np.uint8)


@pytest.mark.parametrize("name", sorted(kernels.EXPLORER))
def test_explorer_keeps_shape(noise, name):
    out = kernels.EXPLORER[name](noise, 5)
    assert out.shape == noise.shape and out.dtype == np.uint8
    assert (out == kernels.EXPLORER[name](noise, 5)).all()


def test_directions():
    y, x = np.mgrid[:128, :128]
    flat, board = np.full((128, 128, 3), 120, np.uint8), kernels.colour(((y + x) % 2 * 255).astype(np.uint8))
    a, b = kernels.diagnose(flat), kernels.diagnose(board)
    assert b["global_contrast"] > a["global_contrast"] and b["sharpness"] > a["sharpness"] and all(np.isfinite(list(a.values())))
    ramp = kernels.colour(np.broadcast_to((105 + x * 30 // 127), (128, 128)).astype(np.uint8))
    assert kernels.diagnose(kernels.lab_clahe(ramp))["local_contrast"] > kernels.diagnose(ramp)["local_contrast"]
    spots = np.full((128, 128, 3), 120, np.uint8)
    spots[::4, ::4], spots[2::4, 2::4] = 255, 0
    assert ((kernels.median(spots, 3) == 255).sum()) < (spots == 255).sum()


@pytest.mark.parametrize("kind", ["ramp", "impulses", "checkerboard"])
def test_expressions_equal_kernels(spark, kind):
    one = rasters.synthetic(spark, kind, 12, 10)
    px, h, w = F.col("px"), F.col("h"), F.col("w")
    row = one.select(
        transforms.gaussian(px, h, w, 5, 0.8).alias("g"), transforms.median(px, h, w, 3).alias("m"), transforms.unsharp(px, h, w, 5, 1.0, 0.8, 3).alias("u"),
        transforms.blackhat(px, h, w, 5).alias("b"), transforms.normalize(px, h, w).alias("n"), transforms.auto_gamma(px, h, w).alias("a"),
        diagnostics.entropy().alias("e"), diagnostics.sharpness().alias("s"), diagnostics.local_contrast().alias("l"), "px",
    ).first()
    img = kernels.colour(np.array(row.px, np.uint8).reshape(12, 10))
    d = kernels.diagnose(img)
    for ours, theirs in ((row.g, kernels.gaussian(img, 5, 0.8)), (row.m, kernels.median(img, 3)), (row.u, kernels.unsharp(img, 5, 1.0, 0.8, 3)), (row.b, kernels.blackhat(img, 5)), (row.n, kernels.normalize(img)), (row.a, kernels.auto_gamma(img))):
        assert ours == theirs[..., 0].ravel().tolist()
    assert row.e == pytest.approx(d["entropy"]) and row.s == pytest.approx(d["sharpness"], abs=1e-6) and row.l == pytest.approx(d["local_contrast"], abs=1e-6)


def test_bad_parameters(noise):
    for bad in (2, 0, -3, 2.5, True):
        with pytest.raises(ValueError, match="odd"):
            transforms.check_kernel(bad)
    with pytest.raises(ValueError):
        kernels.check_image(noise.astype(float))
    with pytest.raises(ValueError):
        catalog.check_catalog((catalog.DEFAULT[0], catalog.DEFAULT[0]))
    with pytest.raises(ValueError, match="sum"):
        catalog.check_weights(catalog.WEIGHTS | {"auto": {"entropy": 0.5}})
    with pytest.raises(ValueError, match="no weights for"):
        catalog.check_weights({"auto": catalog.WEIGHTS["auto"]})
    assert len(catalog.check_catalog(catalog.DEFAULT)) == 10


def test_feature_widths(noise):
    assert features.color_histogram(noise).shape == (96,) and features.color_histogram(noise).sum() == pytest.approx(1, abs=1e-5)
    assert features.hog(noise).shape == (8100,) and features.texture_stats(noise).shape == (24,)


def test_metrics_by_hand(spark):
    classes = spark.createDataFrame([(0,), (1,)], "class_index int")
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "actual int, predicted int").withColumn("k", F.lit(0))
    m = metrics.confusion(rows, classes, ["k"])
    assert {(r.actual, r.predicted): r.n for r in m.collect()} == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 2}
    r = metrics.macro(m, ["k"]).first()
    assert (r.accuracy, r.macro_recall) == (0.75, 0.75) and r.macro_precision == pytest.approx((1 + 2 / 3) / 2)
    zero = metrics.confusion(rows.withColumn("predicted", F.lit(0)), classes, ["k"])
    assert {r.class_index: r.precision for r in metrics.per_class(zero, ["k"]).collect()} == {0: 0.5, 1: 0.0}


def test_scores(spark):
    base = dict(zip(diagnostics.METRICS, (120.0, 0.0, 0.0, 25.0, 12.0, 5.0, 100.0, 10.0, 0.1, 0.08, 0.5, 30.0, 20.0), strict=True))
    row = {f"{s}_{k}": v for s in ("before", "after") for k, v in base.items()} | {"pipeline_id": "same"}
    worse = row | {"pipeline_id": "clipped", "after_dark_clip_ratio": 0.2, "after_sharpness": 10.0, "after_edge_density": 0.5, "after_colorfulness": 1.0}
    df = spark.createDataFrame([row, worse])
    w = {r.pipeline_id: r.w for r in df.select("pipeline_id", scoring.warnings().alias("w")).collect()}
    assert w == {"same": [], "clipped": ["clipping", "excessive_edges", "oversmoothing", "color_loss"]}
    rows = scoring.component_rows(df, ["pipeline_id"], catalog.weights_table(spark), "auto")
    score = {r.pipeline_id: r.score for r in scoring.totals(rows, ["pipeline_id"]).collect()}
    assert score["same"] == pytest.approx(55.0) and score["clipped"] < score["same"]
    assert all("improved" not in r.t for r in scoring.top_reasons(rows.where("pipeline_id = 'same' and metric <> 'clipping_control'"), ["pipeline_id"]).select(scoring.reason_text(F.col("metric"), F.col("value")).alias("t")).collect())


def test_folds(spark):
    df = spark.range(23).select(F.col("id"), (F.col("id") % 2).cast("int").alias("y"))
    got = split.stratified_folds(df, "id", "y", 5).collect()
    assert len(got) == 23 and {r.fold for r in got} == set(range(5))
    sizes = [[sum(r.fold == f and r.y == c for r in got) for f in range(5)] for c in (0, 1)]
    assert all(max(s) - min(s) <= 1 for s in sizes)
    with pytest.raises(ValueError):
        split.fold_count(df.where("y = 0"), "y", 5)
    assert sorted(set(split.numpy_folds([0] * 7 + [1] * 6, 5))) == list(range(5))


def test_learners():
    x = np.array([[float(i), 0.0] for i in range(8)] + [[20.0 + i, 1.0] for i in range(8)])
    x, y = (x - x.mean(0)) / x.std(0), np.repeat([0, 1], 8)
    assert (learn.svm(x, y, x) == y).all() and (learn.nearest(x, y, x) == y).all()


def test_image_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    for c in ("Alpha", "beta"):
        (tmp_path / c).mkdir()
        for i in range(5):
            (tmp_path / c / f"{i}.png").write_bytes(images.encode_png(rng.integers(0, 256, (16, 16, 3)).astype(np.uint8)))
    (tmp_path / "beta" / "bad.PNG").write_text("no image")
    (tmp_path / ".hidden").mkdir()
    found = images.discover(spark, str(tmp_path))
    assert found.class_names == ["Alpha", "beta"] and found.samples.count() == 10 and found.skipped.count() == 1
    assert {r.class_index for r in found.samples.select("class_index").distinct().collect()} == {0, 1}
    one = found.samples.select("image").first().image
    assert kernels.to_array(one).shape == (16, 16, 3)
    with pytest.raises(FileNotFoundError):
        images.discover(spark, str(tmp_path / "none"))


def test_zip_limits(tmp_path):
    import io
    import zipfile

    def packed(*names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, b"x")
        return out.getvalue()

    assert images.extract_zip(packed("top/a/1.png", "top/b/2.png"), tmp_path / "ok").name == "top"
    for i, bad in enumerate((b"no zip", packed(), packed("../up.png"), packed("/abs.png"), packed("c:/x.png"))):
        with pytest.raises(ValueError):
            images.extract_zip(bad, tmp_path / f"bad{i}")
        assert not (tmp_path / f"bad{i}").exists()


def png(px, kind, filters):
    """A PNG with the given filter of each row."""
    import struct
    import zlib

    h, w = px.shape[:2]
    step = px.shape[2] if px.ndim == 3 else 1
    flat = px.reshape(h, w * step).astype(int)
    raw = b""
    for y, f in zip(range(h), filters, strict=True):
        up = flat[y - 1] if y else np.zeros_like(flat[0])
        left, corner = (np.concatenate([np.zeros(step, int), v[:-step]]) for v in (flat[y], up))
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        raw += bytes([f]) + ((flat[y] - (0, left, up, (left + up) // 2, paeth)[f]) % 256).astype(np.uint8).tobytes()
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + bytes(4)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_decoding_bytes(spark, noise):
    assert (images.decode_image(images.encode_png(noise)) == noise).all()
    px = np.random.default_rng(5).integers(0, 256, (5, 4, 4)).astype(np.uint8)
    assert (images.decode_image(png(px[..., :3], 2, range(5))) == px[..., 2::-1]).all() and (images.decode_image(png(px, 6, (4, 3, 2, 1, 0))) == px[..., 2::-1]).all()
    assert (images.decode_image(png(px[..., 0], 0, (1, 2, 3, 4, 4))) == px[..., :1].repeat(3, axis=2)).all()
    import struct

    bmp = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 4, 5, 1, 24, 0, 0, 0, 0, 0, 0) + px[::-1, :, :3].tobytes()
    assert (images.decode_image(bmp) == px[..., :3]).all()
    whole = images.encode_png(noise)
    for bad in (b"", b"text", whole[:60], whole[:16] + b"\xff" * 8 + whole[24:], bmp[:70], b"BM", b"\x89PNG\r\n\x1a\n"):
        with pytest.raises(ValueError):
            images.decode_image(bad)
    df = spark.createDataFrame([(1, whole), (2, b"bad"), (3, None)], "k int, content binary")
    rows = {r.k: r.image for r in images.decode_bytes(df, "k", "content").collect()}
    assert (kernels.to_array(rows[1]) == noise).all() and rows[2] is None and rows[3] is None
    for bad, error in ((1, TypeError), (noise[..., 0], ValueError), (noise.astype(float), ValueError), (noise[:0], ValueError)):
        with pytest.raises(error):
            images.check_bgr(bad)


def test_colours_on_ingest(spark):
    rows = [(1, ("", 1, 2, 1, 0, b"\x01\x02")), (2, ("", 1, 1, 4, 24, b"\x01\x02\x03\x04")), (3, ("", 1, 1, 3, 16, b"abc")), (4, ("", 1, 1, 1, 2, b"ab")), (5, ("", -1, -1, -1, -1, b""))]
    df = spark.createDataFrame(rows, "k int, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    got = {r.k: (bytes(r.image.data), r.ok) for r in images.as_colour(df).withColumn("ok", images.valid()).collect()}
    assert got[1] == (b"\x01\x01\x01\x02\x02\x02", True) and got[2] == (b"\x01\x02\x03", True) and got[3] == (b"abc", True) and not got[4][1] and not got[5][1]


def test_outlines_and_labels():
    img = np.full((40, 40, 3), 20, np.uint8)
    img[5:30, 5:30] = 220
    img[12:22, 12:22] = 20  # a hole has no outline
    out = kernels.contours(img)
    green = (out == (0, 255, 0)).all(axis=2)
    assert green[5, 5:30].all() and green[5:30, 5].all() and not green[10:24, 10:24].any()
    dots = np.zeros((80, 80, 3), np.uint8)
    dots[::4, ::4] = 255  # 400 components
    colours = kernels.labelled(dots)[::4, ::4].reshape(-1, 3)
    assert len(np.unique(colours, axis=0)) > 200 and not kernels.labelled(dots)[1::4].any()


def test_derivative_kernels(noise):
    assert transforms.sobel_taps(3) == transforms.SOBEL and sum(c for *_, c in transforms.sobel_taps(5)) == sum(c for *_, c in transforms.laplacian_taps(5)) == 0
    assert sorted(transforms.laplacian_taps(3)) == [(-1, -1, 2), (-1, 1, 2), (0, 0, -8), (1, -1, 2), (1, 1, 2)]
    assert (kernels.EXPLORER["Sobel"](noise, 3) != kernels.EXPLORER["Sobel"](noise, 5)).any() and (kernels.EXPLORER["Laplacian"](noise, 1) != kernels.EXPLORER["Laplacian"](noise, 3)).any()


def test_samples_and_guidance(spark, tmp_path):
    from lumenforge.sources import samples

    assert samples.demo().shape == (320, 480, 3) and samples.tile(64).shape == (64, 64, 3) and (samples.tile(64) == samples.tile(64)).all()
    ramp = samples.ramp()
    assert (ramp.min(), ramp.max(), ramp.shape) == (105, 135, (128, 128, 3)) and kernels.diagnose(samples.tile())["global_contrast"] < 15
    assert images.discover(spark, str(samples.shapes(tmp_path))).class_names == ["circle", "square"]
    told = kernels.explain(spark, spark.createDataFrame([("Sobel",), ("what",)], "technique string"), "technique").collect()
    assert {r.technique: bool(r.helps) for r in told} == {"Sobel": True, "what": False} and set(kernels.GUIDANCE) == set(kernels.EXPLORER)


def test_descriptors_and_words(spark, noise):
    flat = np.full_like(noise, 90)
    rows = [(i, ("", *x.shape[:2], 3, 16, x.tobytes())) for i, x in enumerate((noise, flat, noise[:9, :9]))]
    df = spark.createDataFrame(rows, "k int, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    found = features.gradient_descriptors(df, ["k"], most=7)
    got = found.collect()
    assert len(got) == 7 and {r.k for r in got} == {0} and all(len(r.features) == 128 and abs(sum(v * v for v in r.features) - 1) < 1e-6 for r in got)
    assert [r.response for r in got] == sorted((r.response for r in got), reverse=True)
    words = spark.createDataFrame([(0, got[0].features), (1, got[1].features)], "word_id int, centre array<double>")
    shares = {r.k: r.histogram for r in features.word_histograms(features.nearest_words(found, words), "k", 2, df).collect()}
    assert sum(shares[0]) == pytest.approx(1) and shares[1] == shares[2] == [0.0, 0.0]


def test_links_of_archives(tmp_path):
    import io
    import stat
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        link = zipfile.ZipInfo("a/link")
        link.external_attr = (stat.S_IFLNK | 0o777) << 16
        z.writestr(link, "/etc/passwd")
    with pytest.raises(ValueError, match="symbolic link"):
        images.extract_zip(out.getvalue(), tmp_path / "x")
    locked = bytearray(out.getvalue().replace(b"a/link", b"a/file"))
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        locked[locked.index(mark) + at] |= 1
    with pytest.raises(ValueError, match="refused"):
        images.extract_zip(bytes(locked), tmp_path / "y")


def test_nearest_neighbours_in_blocks(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(90, 3)).round(1), rng.integers(0, 3, 90)
    rows = spark.createDataFrame([(i, int(y[i]), i % 3, f, x[i].tolist()) for f in range(3) for i in range(90)], "id int, label int, fold int, test_fold int, z array<double>")
    for block in (7, 1000):
        got = {r.id: (r.test_fold, r.actual, r.predicted) for r in learn.knn(rows, "id", "label", block=block).collect()}
        for f in range(3):
            test, train = np.flatnonzero(np.arange(90) % 3 == f), np.flatnonzero(np.arange(90) % 3 != f)
            want = learn.nearest(x[train], y[train], x[test])
            assert [got[i] for i in test] == [(f, y[i], w) for i, w in zip(test, want, strict=True)]


def test_catalogue_files(tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "p.yaml").write_text(yaml.safe_dump({"pipelines": [{"id": "a", "profiles": ["auto"], "rationale_codes": ["r"], "steps": [{"transform": "median", "params": {"kernel_size": 3}}]}]}))
    (tmp_path / "w.yaml").write_text(yaml.safe_dump(catalog.WEIGHTS))
    assert catalog.load_catalog(str(tmp_path / "p.yaml"))[0].rationale == ("r",) and catalog.load_weights(str(tmp_path / "w.yaml")) == catalog.WEIGHTS
    (tmp_path / "p.yaml").write_text("pipelines: 3")
    with pytest.raises(ValueError):
        catalog.load_catalog(str(tmp_path / "p.yaml"))


def test_preservation(spark):
    rows = spark.createDataFrame([(10.0, 8.0), (0.0, 0.0), (0.0, 3.0), (10.0, 30.0)], "b double, a double")
    assert [r[0] for r in rows.select(scoring.preservation(F.col("b"), F.col("a"))).collect()] == pytest.approx([80.0, 100.0, 50.0, 0.0])
