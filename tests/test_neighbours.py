"""Neighbour sums against all pairs."""

import math
import random

import numpy as np
import pytest

from tillwatch.operators.neighbours import CELLS_KM, _sums_within, zone_features
from tillwatch.session import materialise


def haversine(a, b):
    (lat1, lon1), (lat2, lon2) = a, b
    p, q = math.radians(lat1), math.radians(lat2)
    h = (
        math.sin((q - p) / 2) ** 2
        + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    )
    return 2 * 6371 * math.asin(math.sqrt(min(1.0, h)))


def brute(points):
    out = {}
    for k, (at, amount) in points.items():
        near = [
            other
            for j, (where, other) in points.items()
            if j != k and at and where and 0.001 < haversine(at, where) <= 1.0
        ]
        out[k] = (len(near), sum(near) / len(near) if near else amount)
    return out


def check(spark, points):
    profile = spark.createDataFrame([(k, float(v)) for k, (_, v) in points.items()], "cod_cajero string, dispensacion_promedio double")
    machines = spark.createDataFrame(
        [(k, *(map(str, at) if at else (None, None)), "m", "d") for k, (at, _) in points.items()],
        "codigo string, latitud string, longitud string, municipio_dane string, departamento string",
    )
    got = {r.cod_cajero: r for r in zone_features(profile, machines).collect()}
    assert len(got) == len(points)
    for k, (n, mean) in brute(points).items():
        assert got[k].cajeros_cercanos_1km == n, k
        assert got[k].dispensacion_promedio_zona == pytest.approx(mean, rel=1e-9)
        expected = points[k][1] / mean if mean > 0 else 1.0
        assert got[k].ratio_vs_zona == pytest.approx(expected, rel=1e-9)


def test_scattered_dense_and_shared_places(spark):
    rng = random.Random(11)
    points = {}
    for i in range(60):  # a town
        points[f"t{i}"] = ((4.6 + rng.uniform(-0.03, 0.03), -74.08 + rng.uniform(-0.03, 0.03)), rng.randrange(1, 10**6))
    for i in range(120):  # one dense block of some 30 metres: a third of everything and more
        points[f"d{i}"] = ((4.6 + rng.uniform(0, 0.0003), -74.08 + rng.uniform(0, 0.0003)), rng.randrange(1, 10**6))
    for i in range(40):  # one site
        points[f"s{i}"] = ((4.601, -74.081), rng.randrange(1, 10**6))
    for i in range(10):  # within a metre of the site: counts as the same place
        points[f"m{i}"] = ((4.601 + i * 1e-6, -74.081), rng.randrange(1, 10**6))
    points["edge"] = ((4.6 + 1.0 / 111.2, -74.08), 5)
    points["alone"] = ((10.0, -60.0), 7)
    points["nowhere"] = (None, 9)
    points["zero"] = ((20.0, 20.0), 0)
    check(spark, points)


@pytest.mark.parametrize("seed, lat, lon", [(1, 4.6, -74.08), (2, -33.4, 151.2), (3, 59.9, 10.7)])
def test_dense_district_across_many_cell_borders(spark, seed, lat, lon):
    rng = np.random.default_rng(seed)
    n = 6000
    at = np.column_stack([lat + rng.uniform(0, 0.011, n), lon + rng.uniform(0, 0.011, n)]).round(6)
    amount = rng.integers(1, 10**6, n).astype(float)
    p, q = np.radians(at).T
    h = (
        np.sin((p[:, None] - p) / 2) ** 2
        + np.cos(p)[:, None] * np.cos(p) * np.sin((q[:, None] - q) / 2) ** 2
    )
    far = 2 * 6371 * np.arcsin(np.sqrt(h))
    near = (far > 0.001) & (far <= 1.0)
    profile = spark.createDataFrame(
        [(str(i), v) for i, v in enumerate(amount.tolist())], "cod_cajero string, dispensacion_promedio double"
    )
    machines = spark.createDataFrame(
        [(str(i), *x, "m", "d") for i, x in enumerate(at.tolist())],
        "codigo string, latitud double, longitud double, municipio_dane string, departamento string",
    )
    got = {int(r.cod_cajero): r for r in zone_features(profile, machines).collect()}
    assert [got[i].cajeros_cercanos_1km for i in range(n)] == near.sum(axis=1).tolist()
    means = (near * amount).sum(axis=1) / near.sum(axis=1)
    assert [got[i].dispensacion_promedio_zona for i in range(n)] == pytest.approx(means.tolist(), rel=1e-9)


def test_far_north_equator_and_date_line(spark):
    rng = random.Random(12)
    points = {}
    for name, lat, lon in (("n", 69.65, 18.95), ("e", 0.0, 30.0), ("f", -16.9, 179.9995), ("s", -54.8, -68.3)):
        for i in range(30):
            x = lon + rng.uniform(-0.02, 0.02)
            x = x - 360 if x > 180 else x
            points[f"{name}{i}"] = ((lat + rng.uniform(-0.01, 0.01), x), rng.randrange(1, 1000))
    check(spark, points)


def test_no_coordinates_at_all(spark):
    check(spark, {"a": (None, 3), "b": (None, 4)})


def test_text_that_is_no_number(spark):
    profile = spark.createDataFrame([("a", 2.0)], "cod_cajero string, dispensacion_promedio double")
    machines = spark.createDataFrame(
        [("a", "norte", "-74", "m", "d")],
        "codigo string, latitud string, longitud string, municipio_dane string, departamento string",
    )
    row = zone_features(profile, machines).first()
    assert (row.latitud, row.cajeros_cercanos_1km, row.dispensacion_promedio_zona) == (None, 0, 2.0)


def test_no_cartesian_product(spark):
    profile = spark.createDataFrame([("a", 2.0)], "cod_cajero string, dispensacion_promedio double")
    machines = spark.createDataFrame(
        [("a", 1.0, 1.0, "m", "d")],
        "codigo string, latitud double, longitud double, municipio_dane string, departamento string",
    )
    plan = zone_features(profile, machines)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_unfolded_circles_are_not_broadcast(spark):
    sites = spark.createDataFrame([(4.0 + i * 0.001, -74.0, 1, 10.0) for i in range(50)], "lat double, lon double, n long, total double")
    plan = _sums_within(materialise(sites, "sites"), 1.0, CELLS_KM)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
