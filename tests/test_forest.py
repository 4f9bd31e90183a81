"""Properties of the isolation forest."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwatch.operators import isolation_forest as forest
from tillwatch.session import work_dir

FEATURES = ["a", "b", "c", "flag"]
KEYS = ["cod_terminal", "bucket_15min"]
OPTIONS = dict(trees=60, share=1.0, contamination=0.02, seed=7)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(3000):
        far = i < 30
        a, b = rng.normal(12 if far else 0, 1, 2)
        c = None if i % 50 == 0 else float("inf") if i % 77 == 0 else float(rng.normal())
        at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=15 * i)
        rows.append((i % 17, at, float(a), float(b), c, bool(i % 2), far))
    schema = "cod_terminal int, bucket_15min timestamp_ntz, a double, b double, c double, flag boolean, far boolean"
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="module")
def model(data):
    return forest.fit_forest(data, FEATURES, KEYS, **OPTIONS)


def test_planted_outliers_score_lowest(model, data):
    scored = model.transform(data)
    worst = scored.orderBy("score_modelo").limit(30).collect()
    assert sum(r.far for r in worst) >= 29
    assert scored.filter("score_modelo < -1 OR score_modelo > 0").count() == 0
    assert scored.filter("far").agg(F.min("score_anomalia")).first()[0] > 60


def test_share_flagged_is_the_contamination(model, data):
    check = forest.training_check(model.transform(data)).first()
    assert check.pct_anomalias == pytest.approx(2.0, abs=0.1)
    assert (check.score_min, check.score_max) == (0.0, 1.0)


def test_trees_have_full_samples_and_bounded_depth(model):
    roots = model.nodes[model.nodes.nodo == 0]
    assert len(roots) == 60 and (roots.filas == 256).all() and model.psi == 256
    assert model.nodes.hondura.max() <= 8
    assert len(model.nodes) <= 60 * (2 * 256 - 1)
    children = model.nodes[model.nodes.variable >= 0]
    assert (children.izquierda > 0).all() and (children.derecha > 0).all()
    assert (model.nodes.filas > 0).all()


def test_result_does_not_depend_on_partitioning(model, data):
    again = forest.fit_forest(data.repartition(13, "a"), FEATURES, KEYS, **OPTIONS)
    order = ["arbol", "nodo"]
    a, b = (m.nodes.sort_values(order).reset_index(drop=True) for m in (model, again))
    assert (a[["variable", "izquierda", "filas"]] == b[["variable", "izquierda", "filas"]]).all().all()
    assert a.corte.to_numpy() == pytest.approx(b.corte.to_numpy(), rel=1e-9)
    assert again.offset == pytest.approx(model.offset, rel=1e-9)


def test_saved_forest_scores_the_same(spark, model, data):
    path = work_dir(spark, "model")
    model.save(spark, path)
    loaded = forest.load_forest(spark, path)
    assert loaded.features == FEATURES and loaded.metadata["total_registros_entrenamiento"] == 3000
    assert loaded.metadata["cajeros_unicos"] == 17
    a, b = (m.transform(data).agg(F.sum("score_modelo"), F.count_if("es_anomalia")).first() for m in (model, loaded))
    assert a == b


def test_missing_values_take_the_training_median(model, data):
    c = sorted(r.c for r in data.collect() if r.c is not None and np.isfinite(r.c))
    assert model.medians["c"] == pytest.approx(float(np.median(c)))
    mean, std = model.scaler["flag"]
    assert (mean, std) == (0.5, 0.5)


def test_tiny_and_constant_tables(spark):
    rows = [(i, dt.datetime(2024, 1, 1), 1.0, 2.0) for i in range(5)]
    df = spark.createDataFrame(rows, "cod_terminal int, bucket_15min timestamp_ntz, a double, b double")
    model = forest.fit_forest(df, ["a", "b"], KEYS, trees=10)
    assert len(model.nodes) == 10 and model.psi == 5
    assert {r.es_anomalia for r in model.transform(df).collect()} == {False}


def test_all_rows_are_fitted_on(spark):
    rows = 2_050_000
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    df = spark.range(rows).select(F.col("id").alias("cod_terminal"), at.alias("bucket_15min"), (F.col("id") % 1000).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    model = forest.fit_forest(df, ["a", "b"], KEYS, trees=2)
    assert model.metadata["total_registros_entrenamiento"] == model.metadata["cajeros_unicos"] == rows
    assert (model.medians["a"], model.scaler["a"][0]) == pytest.approx((499.5, 499.5), abs=1e-6)


def test_sample_does_not_depend_on_partitioning(data):
    one = forest.sample_rows(data, 500, KEYS)
    two = forest.sample_rows(data.repartition(9), 500, KEYS)
    assert 400 < one.count() < 600
    assert one.select(*KEYS).exceptAll(two.select(*KEYS)).isEmpty()
    assert forest.sample_rows(data, 10_000, KEYS).count() == 3000


def test_average_path_length():
    assert forest._average_path(np.array([0, 1, 2, 256])) == pytest.approx([0, 0, 1, 10.2448], abs=1e-3)
