"""Stacks of images: the values of the kernels image by image, sizes that differ, and advice from far fewer calls."""

import numpy as np
import pytest

from lumenforge.operators import kernels, stacks
from lumenforge.plans import advisor, catalog, catalogue

SF = "/root/testdata/sf0.001"


def images(h: int, w: int, n: int = 5) -> np.ndarray:
    """Noise, a ramp, a flat image, grey blocks, a few levels."""
    rng = np.random.default_rng(h * 100 + w)
    noise, few = rng.integers(0, 256, (h, w, 3)), rng.integers(100, 104, (h, w, 3))
    ramp = np.broadcast_to(np.linspace(0, 255, w)[None, :, None], (h, w, 3))
    blocks = np.kron(rng.integers(0, 256, (-(-h // 4), -(-w // 4))), np.ones((4, 4)))[:h, :w, None].repeat(3, 2)
    return np.stack([noise, ramp, np.full((h, w, 3), 255), blocks, few]).astype(np.uint8)[:n]


@pytest.mark.parametrize(("h", "w"), [(32, 32), (17, 40), (9, 7), (64, 20)])
def test_stacks_have_the_kernels_values(h, w):
    x = images(h, w)
    for name, transform in kernels.REGISTRY.items():
        if transform in stacks.STACKED:
            for params in [{}, *[s.params for p in catalog.DEFAULT for s in p.steps if s.transform == name]]:
                got = stacks.stacked(transform)(x, **params)
                assert got.dtype == np.uint8 and all((a == transform(img, **params)).all() for a, img in zip(got, x, strict=True)), name
    found = stacks.diagnose(x)
    for i, img in enumerate(x):
        assert {k: float(v[i]) for k, v in found.items()} == pytest.approx(kernels.diagnose(img), rel=1e-9, abs=1e-9)


def test_images_of_several_sizes_keep_their_own_rows(spark):
    stacks_of = [images(16, 16), images(9, 12, 3), images(16, 16, 1)]
    rows = [(f"{i}-{j}", (*img.shape, 16, img.tobytes())) for i, s in enumerate(stacks_of) for j, img in enumerate(s)]
    df = spark.createDataFrame(rows, "path string, image struct<height:int,width:int,nChannels:int,mode:int,data:binary>").coalesce(1)
    got = {r.path: (r.level, r.n) for r in stacks.map_stacks(df, ["path"], lambda x: [[{"level": float(img.mean()), "n": len(x)}] for img in x], "level double, n int").collect()}
    assert {k: v[0] for k, v in got.items()} == {f"{i}-{j}": float(img.mean()) for i, s in enumerate(stacks_of) for j, img in enumerate(s)}
    assert got["0-0"][1] == 6 and got["1-0"][1] == 3


def test_advice_has_the_kernels_figures(spark):
    df = catalogue._as_images(spark, SF).limit(8).withColumnRenamed("image_id", "path").cache()
    found = {(r.path, r.pipeline_id): r for r in advisor.measure(df, "auto").collect()}
    assert len(found) == 8 * 8
    for r in df.collect():
        img = kernels.to_array(r.image)
        for p in catalog.DEFAULT:
            if "auto" in p.profiles:
                done = img
                for s in p.steps:
                    done = kernels.REGISTRY[s.transform](done, **s.params)
                row = found[r.path, p.id].asDict()
                for when, of in (("before", img), ("after", done)):
                    assert {k: row[f"{when}_{k}"] for k in kernels.diagnose(of)} == pytest.approx(kernels.diagnose(of), rel=1e-9, abs=1e-9)


def test_advice_makes_no_call_for_each_image(spark, monkeypatch):
    def refused(img):
        raise AssertionError("an image was measured alone")

    monkeypatch.setattr(kernels, "diagnose", refused)
    x, made = images(32, 32), []
    monkeypatch.setattr(stacks, "map_stacks", lambda df, keys, f, schema: made.append(f))
    advisor.measure(None, "auto")
    rows = made[0](x)
    assert [len(r) for r in rows] == [8] * len(x) and len({round(r[0]["processing_ms"], 9) for r in rows}) == 1


def test_a_small_file_is_dealt_to_many_tasks(spark):
    assert spark.read.parquet(f"{SF}/embeddings.parquet").rdd.getNumPartitions() == 1
    images = catalogue._as_images(spark, SF)
    at = [n for n in images.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
    assert sum(at) == 500 and len(at) >= 2 * spark.sparkContext.defaultParallelism - 1 and max(at) < 250
