"""Every query with SQL gives the rows that the SQL gives."""

import hashlib

import duckdb
import numpy as np
import pytest

from conftest import SF
from lumenforge.operators import kernels, learn
from lumenforge.plans import catalog, catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(map(plain, r)) for r in pdf[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    ours = rows(catalogue.queries()[name](spark, SF).toPandas())
    assert ours == rows(duck.sql(catalogue.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()) - {"svm_cv", "svm_cascade", "random_forest_cv", "kmeans_vocabulary", "advise_catalogue", "scale_descriptors", "scale_words"}))
def test_kernels_give_rows(spark, name):
    rows = catalogue.queries()[name](spark, SF).collect()
    assert len(rows) == len({r.image_id for r in rows}) == 500
    if name.startswith("explore_"):  # the same bytes from the kernel itself
        images = {r.image_id: kernels.to_array(r.image) for r in catalogue._as_images(spark, SF).limit(9).collect()}
        f = next(f for k, f in kernels.EXPLORER.items() if name == "explore_" + k.lower().replace(" ", "_"))
        told = {r.image_id: r.sha256 for r in rows}
        assert all(told[i] == hashlib.sha256(f(img, 5).tobytes()).hexdigest() for i, img in images.items())


def test_the_whole_catalogue_is_ranked(spark):
    rows = catalogue.queries()["advise_catalogue"](spark, SF).collect()
    names = {p.id for p in catalog.DEFAULT if "auto" in p.profiles}
    assert len(rows) == 1500 and {r["rank"] for r in rows} == {1, 2, 3} and {r.pipeline_id for r in rows} <= names and len({(r.image_id, r.pipeline_id) for r in rows}) == 1500


def test_fitted_words(spark):
    """Each image's share of words, from the fitted centres by plain distances."""
    rows = {r.image_id: r.histogram for r in catalogue.queries()["bovw_fitted"](spark, SF).collect()}
    assert len(rows) == 500 and all(len(h) == 16 and abs(sum(h) - 1) < 1e-9 and all(abs(x * 8 - round(x * 8)) < 1e-9 for x in h) for h in rows.values())
    assert sum(1 for k in range(16) if any(h[k] for h in rows.values())) > 8


def test_no_python_in_relational_plans(spark):
    plan = catalogue.queries()["top3_recommendations"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(5).count() == 5


def test_random_forest_predicts_each_row_once(spark):
    rows = catalogue.queries()["random_forest_cv"](spark, SF).toPandas()
    folds = catalogue.queries()["stratified_folds"](spark, SF).toPandas()
    assert sorted(rows.vec_id) == sorted(folds.vec_id) and set(rows.test_fold) == set(range(5))
    both = rows.merge(folds, on="vec_id")
    assert (both.test_fold == both.fold).all() and (both.actual == both.label).all() and both.predicted.isin(folds.label).all()


def test_svm_is_fitted_on_the_cluster(spark):
    frame = catalogue.queries()["svm_cv"](spark, SF)
    plan = frame._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "MapInPandas" not in plan
    rows, folds = frame.toPandas(), catalogue._folded(spark, SF).toPandas()
    assert sorted(rows.vec_id) == sorted(folds.vec_id)
    both = rows.merge(folds, on="vec_id")
    assert (both.test_fold == both.fold).all() and (both.actual == both.label).all()


def test_svm_is_close_to_the_exact_machine(spark):
    rng = np.random.default_rng(4)
    y = np.arange(180) % 3
    turn, radius = rng.uniform(0, 2 * np.pi, 180), y + 0.5 + rng.uniform(0, 0.4, 180)
    x = np.column_stack([radius * np.cos(turn), radius * np.sin(turn)])  # rings: no straight line parts them
    rows = spark.createDataFrame([(i, int(y[i] * 5), i % 4, f, x[i].tolist()) for f in range(4) for i in range(180)], "id long, label int, fold int, test_fold int, z array<double>")
    got = learn.svm_cv(rows, "id", "label", c=50.0, gamma=1.0).toPandas().sort_values("id")
    assert got.id.tolist() == list(range(180)) and (got.test_fold == got.id % 4).all()
    exact = np.concatenate([learn.svm(x[np.arange(180) % 4 != f], y[np.arange(180) % 4 != f], x[np.arange(180) % 4 == f], 50.0, 1.0) for f in range(4)])
    order = np.concatenate([np.flatnonzero(np.arange(180) % 4 == f) for f in range(4)])
    assert (got.predicted.to_numpy()[order] == exact * 5).mean() > 0.9 and (got.predicted == got.actual).mean() > 0.9
