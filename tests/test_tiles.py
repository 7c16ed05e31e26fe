"""Images as tiles against whole images: every transform, pipelines, components, edges; registered transforms."""

import numpy as np
import pytest

from lumenforge.operators import features, graph, kernels, tiles, transforms
from lumenforge.plans import benchmark, catalog
from lumenforge.plans.catalog import Step

IMAGE = "struct<height:int,width:int,nChannels:int,mode:int,data:binary>"


def pictures() -> list[np.ndarray]:
    rng = np.random.default_rng(5)
    y, x = np.mgrid[:61, :83]
    smooth = np.stack([(y * 3 + x) % 256, 128 + 90 * np.sin(x / 7) * np.cos(y / 5), 255 - (y * x) % 200], axis=2)
    return [smooth.astype(np.uint8), rng.integers(0, 256, (40, 33, 3)).astype(np.uint8), rng.integers(90, 130, (24, 24, 3)).astype(np.uint8), np.full((17, 50, 3), 77, np.uint8)]


@pytest.fixture(scope="module")
def cut(spark):
    rows = [(i, "k", (p.shape[0], p.shape[1], 3, 16, p.tobytes())) for i, p in enumerate(pictures())]
    return tiles.cut(spark.createDataFrame(rows, f"id int, side string, image {IMAGE}"), ["id", "side"], 16).cache()


def joined(df) -> dict[int, np.ndarray]:
    out: dict = {}
    for t in df.collect():
        x = np.frombuffer(t.data, np.uint8).reshape(t.rows, t.cols, -1)
        whole = out.setdefault(t.id, np.zeros((t.height, t.width, x.shape[2]), np.uint8))
        whole[t.top : t.top + t.rows, t.left : t.left + t.cols] = x
    return out


STEPS = [
    [Step("normalize")], [Step("lab_clahe", {"clip_limit": 2.0, "grid_size": 3})], [Step("auto_gamma", {"target_midpoint": 0.4})], [Step("gaussian", {"kernel_size": 7, "sigma": 1.1})],
    [Step("median", {"kernel_size": 5})], [Step("bilateral", {"diameter": 7, "sigma_color": 40, "sigma_space": 40})], [Step("unsharp", {"kernel_size": 5, "sigma": 1.0, "amount": 0.7, "threshold": 2})],
    [Step("gray_bgr")], [Step("blackhat", {"kernel_size": 9, "shape": "ellipse"})], [Step("median", {"kernel_size": 3}), Step("gaussian", {"kernel_size": 5}), Step("unsharp", {"kernel_size": 5})],
]


@pytest.mark.parametrize("steps", [*STEPS, *[list(p.steps) for p in catalog.DEFAULT if len(p.steps) > 1]], ids=lambda s: "-".join(x.transform for x in s))
def test_tiles_equal_whole_images(cut, steps):
    got = joined(tiles.transformed(cut, ["id", "side"], steps))
    runnable = benchmark.runnable(catalog.Pipeline("p", ("auto",), tuple(steps)))
    for i, p in enumerate(pictures()):
        assert np.array_equal(got[i], benchmark.run_pipeline(p, runnable)), i


def test_cut_covers_each_sample_once(cut):
    assert all(np.array_equal(joined(cut)[i], p) for i, p in enumerate(pictures()))
    with pytest.raises(ValueError, match="positive"):
        tiles.cut(cut, ["id"], 0)


def test_a_halo_wider_than_a_tile_is_refused(cut):
    with pytest.raises(Exception, match="as wide as the halo"):
        tiles.local(cut, ["id", "side"], 17, lambda x: x).count()


def test_components_over_tiles(spark):
    rng = np.random.default_rng(9)
    snake = np.zeros((50, 70), bool)
    snake[::4] = True
    snake[2::8, -1] = snake[1::8, -1] = snake[3::8, -1] = True
    snake[6::8, 0] = snake[5::8, 0] = snake[7::8, 0] = True
    corner = np.zeros((33, 33), bool)
    corner[15, 15] = corner[16, 16] = corner[15, 17] = corner[14, 18] = corner[32, 0] = True
    masks = [snake, corner, rng.random((64, 61)) < 0.4, rng.random((20, 90)) < 0.3, np.zeros((20, 20), bool), np.ones((40, 40), bool)]
    rows = [(i, (m.shape[0], m.shape[1], 3, 16, np.repeat(m[..., None], 3, axis=2).astype(np.uint8).tobytes())) for i, m in enumerate(masks)]
    cut = tiles.cut(spark.createDataFrame(rows, f"id int, image {IMAGE}"), ["id"], 16)
    found = tiles.component_sizes(tiles.local(cut, ["id"], 0, lambda x: x[..., :1]), ["id"])
    got: dict = {i: [] for i in range(len(masks))}
    for r in found.collect():
        got[r.id].append(r.samples)
    for i, m in enumerate(masks):
        assert sorted(got[i]) == sorted(np.bincount(kernels.components(m).ravel())[1:].tolist()), i


def test_edge_metrics_over_tiles(cut):
    got = {r.id: (r.edge_density, r.edge_continuity) for r in tiles.edge_metrics(cut, ["id", "side"]).collect()}
    for i, p in enumerate(pictures()):
        assert got[i] == pytest.approx(kernels.edge_metrics(kernels.grey(p))), i
    assert got[0][0] > 0


def test_graph_components(spark):
    import random

    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(300 + i, 300) for i in range(50)] + [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(180)] + [(5, 5), (None, 3), (7, None)]
    rng.shuffle(edges)
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_turbo_runs_from_dark_blue_over_green_to_red():
    b, g, r = kernels.turbo(np.array([0.0, 0.25, 0.5, 0.75, 1.0])).astype(int).T
    assert (r[0], g[0], b[0]) == (35, 23, 27) and g[2] > 240 and r[3] > 240 and r[4] > 2 * max(g[4], b[4])


def test_registered_transforms_and_features_run_in_tasks(spark, tmp_path):
    name = "half_of_it"
    if name not in kernels.REGISTRY:
        with pytest.raises(ValueError, match="unknown transform"):
            transforms.check_config(name, {})
        kernels.register(name, lambda img, by=2: img // by)
        features.register("mean_levels", lambda img: img.mean(axis=(0, 1)).astype(np.float32))
    with pytest.raises(ValueError, match="of its own"):
        kernels.register("median", lambda img: img)
    own = catalog.check_catalog((catalog.Pipeline("own", ("auto",), (Step(name, {"by": 4}),)),))
    from lumenforge.sources import images

    rng = np.random.default_rng(0)
    for c in ("a", "b"):
        (tmp_path / c).mkdir()
        for i in range(6):
            (tmp_path / c / f"{i}.png").write_bytes(images.encode_png(np.full((16, 16, 3), (40 if c == "a" else 200) + int(rng.integers(0, 20)), np.uint8)))
    manifest = images.discover(spark, str(tmp_path))
    got = benchmark.run(spark, manifest, benchmark.Config(("original", "own"), ("mean_levels",), ("knn",), 2), own)
    assert {(r.pipeline_id, r.feature_profile, r.mean_accuracy) for r in got.leaderboard.collect()} == {("own", "mean_levels", 1.0), ("original", "mean_levels", 1.0)}
