"""Scale-invariant descriptors: turned, halved and dimmed images, places, lengths, flat images, words by training fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenforge.operators import features, scale_space
from lumenforge.plans import catalogue

SF = "/root/testdata/sf0.001"


def scene(n: int = 200, seed: int = 1) -> np.ndarray:
    """Elongated bright and dark blobs."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:n, :n]
    g = np.full((n, n), 90.0)
    for _ in range(45):
        (cy, cx), (a, b), t = rng.uniform(20, n - 20, 2), rng.uniform(3, 14, 2), rng.uniform(0, 3.14)
        u, v = (x - cx) * np.cos(t) + (y - cy) * np.sin(t), (y - cy) * np.cos(t) - (x - cx) * np.sin(t)
        g += rng.uniform(-110, 110) * np.exp(-((u / a) ** 2) - (v / b) ** 2)
    return np.clip(g, 0, 255)


def matched(one: list[dict], other: list[dict], where, within: float) -> tuple[int, int]:
    """(matches at the right place, matches) by the ratio of the two nearest descriptors."""
    a, b = (np.array([d["features"] for d in ds]) for ds in (one, other))
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    near = d.argsort(1)[:, :2]
    right = told = 0
    for i, p in enumerate(one):
        if d[i, near[i, 0]] < 0.8 * d[i, near[i, 1]]:
            y, x = where(p["y"], p["x"])
            told += 1
            right += abs(other[near[i, 0]]["y"] - y) < within and abs(other[near[i, 0]]["x"] - x) < within
    return right, told


@pytest.mark.parametrize("seed", [1, 2])
def test_turned_halved_and_dimmed_images_match(seed):
    g = scene(seed=seed)
    n, own = len(g), scale_space.describe(g)
    half = scale_space.blur(g, 1.0)[::2, ::2]
    for changed, where in (
        (np.rot90(g), lambda y, x: (n - 1 - x, y)), (half, lambda y, x: (y / 2, x / 2)), (np.rot90(half), lambda y, x: (n / 2 - 1 - x / 2, y / 2)), (g * 0.6 + 20, lambda y, x: (y, x)),
    ):
        other = scale_space.describe(changed)
        right, told = matched(own, other, where, 2)
        assert told >= 0.7 * min(len(own), len(other)) and right >= 0.9 * told


def test_a_blob_is_found_where_it_is_and_as_large_as_it_is():
    y, x = np.mgrid[:128, :128]
    for sigma, cy, cx in ((4, 60.3, 55.7), (8, 64.0, 70.25)):
        best = scale_space.describe(40 + 180 * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * sigma**2)))[0]
        assert abs(best["y"] - cy) < 0.5 and abs(best["x"] - cx) < 0.5 and 0.6 * sigma < best["scale"] < 1.4 * sigma


def test_descriptors_have_length_one_and_come_by_response():
    found = scale_space.describe(scene(), most=12)
    assert len(found) == 12 and [d["response"] for d in found] == sorted((d["response"] for d in found), reverse=True)
    for d in found:
        assert len(d["features"]) == 128 and abs(np.linalg.norm(d["features"]) - 1) < 1e-9 and max(d["features"]) < 0.45


def test_flat_and_tiny_images_have_none():
    for g in (np.zeros((1, 1)), np.zeros((5, 7)), np.full((64, 64), 7.0)):
        assert scale_space.describe(g) == []


def test_words_see_the_training_folds_alone(spark):
    g = scene(96)
    imgs = [np.repeat(np.clip(g + 6 * i, 0, 255).astype(np.uint8)[..., None], 3, axis=2) for i in range(4)] + [np.full((96, 96, 3), 9, np.uint8)]
    rows = [(i, i % 2, (96, 96, 3, 16, im.tobytes())) for i, im in enumerate(imgs)]
    df = spark.createDataFrame(rows, "k int, fold int, image struct<height:int,width:int,nChannels:int,mode:int,data:binary>")
    found = features.scale_descriptors(df, ["k"]).cache()
    assert {r.k for r in found.select("k").distinct().collect()} == {0, 1, 2, 3}
    images = df.select("k", "fold")
    words = {(r.test_fold, r.k): r.histogram for r in features.fold_words(found, "k", images, 4).collect()}
    assert set(words) == {(f, k) for f in (0, 1) for k in range(5)} and words[0, 4] == [0.0] * 4
    # The same without the test fold's descriptors: nothing of them is in the vocabulary.
    train = found.join(images, "k").where("fold <> 0")
    alone = features.word_histograms(features.nearest_words(found, features.fit_vocabulary(train, 4)), "k", 4)
    for r in alone.collect():
        assert words[0, r.k] == pytest.approx(r.histogram)
    with pytest.raises(ValueError, match="fewer descriptors"):
        features.fold_words(found.where("k < 2").limit(3), "k", images.where("k < 2"), 400)


def test_queries_cover_every_raster(spark):
    d = catalogue.queries()["scale_descriptors"](spark, SF)
    assert d.where((F.size("features") != 128) | (F.col("scale") <= 0)).count() == 0
    words = catalogue.queries()["scale_words"](spark, SF)
    assert words.groupBy("test_fold").count().where("count <> 500").count() == 0


def test_stacks_are_described_as_their_images():
    """Together, with the same bits, also where an image has no keypoints."""
    stack = np.stack([scene(64, seed=s) for s in (1, 2)] + [np.full((64, 64), 7.0), scene(64, seed=3)])
    found = scale_space.describe_stack(stack)
    assert found == [scale_space.describe(g) for g in stack] and len(found[0]) > 3 and found[2] == []


def test_words_of_all_folds_take_one_pass(spark, monkeypatch):
    """Not an expression over all words for each fold, and no join where descriptors know their fold."""
    monkeypatch.setattr(features, "nearest_words", lambda *a: pytest.fail("words were looked up fold by fold"))
    rng = np.random.default_rng(4)
    rows = [(i % 12, i % 12 % 3, rng.normal(size=8).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, fold int, features array<double>").cache()
    images = spark.createDataFrame([(i, i % 3) for i in range(13)], "k int, fold int")
    got = {(r.test_fold, r.k): r.histogram for r in features.fold_words(df, "k", images, 4).collect()}
    joined = {(r.test_fold, r.k): r.histogram for r in features.fold_words(df.drop("fold"), "k", images, 4).collect()}
    assert set(got) == set(joined) and len(got) == 39 and all(got[f, 12] == [0.0] * 4 for f in range(3))
    for f in range(3):
        centres = np.array([r.centre for r in features.fit_vocabulary(df.where(F.col("fold") != f), 4).orderBy("word_id").collect()])
        for k in range(12):
            own = np.array([x for i, _, x in rows if i == k])
            near = ((own[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            assert got[f, k] == pytest.approx(np.bincount(near, minlength=4) / len(own))
