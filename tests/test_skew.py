"""Skew-proof forms give the rows of the plain forms, with one key owning most rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillwatch.plans import skew
from tillwatch.plans.quantiles import exact_quantiles
from tillwatch.session import materialise

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def hot(spark):
    """Two thirds of the rows belong to key 0; many rows share a second."""
    rng = random.Random(3)
    rows = [
        (i, 0 if i % 3 else rng.randrange(1, 6), START + dt.timedelta(seconds=rng.randrange(0, 40_000)), rng.random() < 0.4)
        for i in range(3000)
    ]
    schema = "id long, k int, ts timestamp_ntz, hit boolean"
    return spark.createDataFrame(rows, schema).repartition(7).cache()


def rows(df, *columns):
    return sorted(df.select(*columns).collect(), key=repr)


def test_previous_equals_lag(hot):
    plain = hot.withColumn("p", F.lag("ts").over(Window.partitionBy("k").orderBy("ts", "id")))
    for unit in (None, "second", "minute", "hour", "day"):
        cut = skew.with_previous(hot, ["k"], "ts", ["id"], "p", unit)
        assert rows(cut, "id", "p") == rows(plain, "id", "p")


def test_lookback_equals_range_frame(hot):
    frame = Window.partitionBy("k").orderBy(skew.micros("ts")).rangeBetween(-600_000_000, 0)
    plain = hot.withColumn("n", F.count(F.lit(1)).over(frame)).withColumn("s", F.sum("id").over(frame))
    cut = skew.with_lookback(hot, ["k"], "ts", 600, {"n": F.count(F.lit(1)), "s": F.sum("id")})
    assert rows(cut, "id", "n", "s") == rows(plain, "id", "n", "s")


def test_running_count_equals_running_sum(hot):
    frame = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = hot.withColumn("c", F.sum(F.col("hit").cast("int")).over(frame))
    for unit in (None, "minute", "hour"):
        cut = skew.with_running_count(hot, ["k"], "ts", ["id"], F.col("hit"), "c", unit)
        assert rows(cut, "id", "c") == rows(plain, "id", "c")


def test_slices_get_finer_for_a_hot_key(hot):
    hours = skew.hourly(hot, ["k"], "ts")
    units = [skew.slice_unit(hot, ["k"], "ts", hours, n) for n in (10_000, 1000, 30, 1)]
    assert units == ["month", "hour", "minute", "second"]


@pytest.mark.parametrize("how", ["left", "inner", "left_anti"])
def test_salted_join_equals_broadcast_join(spark, hot, how):
    dim = spark.createDataFrame([(0, "a"), (2, "b"), (4, "c")], "k int, name string")
    small = skew.lookup_join(hot, dim, ["k"], how)
    salted = skew.lookup_join(hot, dim, ["k"], how, max_rows=1)
    assert sorted(small.columns) == sorted(salted.columns)
    assert rows(small, *small.columns) == rows(salted, *small.columns)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()


def test_salting_spreads_the_hot_key(spark, hot):
    salts = hot.filter("k = 0").select(F.pmod(F.xxhash64(*hot.columns), F.lit(skew.SALTS)).alias("s"))
    assert salts.distinct().count() == skew.SALTS


@pytest.fixture
def small_tasks(spark):
    """Sizes at which adaptive execution acts, for tables of a test."""
    settings = {"autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "64k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    settings = {f"spark.sql.{k}": v for k, v in settings.items()}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["left", "inner", "left_anti"])
def test_a_large_lookup_side_is_not_repeated(spark, small_tasks, how):
    n = 2_100_000
    dim = spark.range(n, numPartitions=4).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    key = F.when(F.col("id") % 3 > 0, 5).when(F.col("id") % 99 == 0, None).when(F.col("id") % 99 == 3, -1).otherwise(F.col("id"))
    fact = spark.range(60_000, numPartitions=8).select("id", key.alias("k"))
    joined = skew.lookup_join(fact, dim, ["k"], how)
    plan = joined._jdf.queryExecution()
    assert "Generate" not in plan.optimizedPlan().toString()
    met = fact.filter("k >= 0").count()
    assert joined.count() == {"left": 60_000, "inner": met, "left_anti": 60_000 - met}[how]
    if how != "left_anti":
        assert joined.agg(F.sum("v")).first()[0] == fact.agg(F.sum(F.when(F.col("k") >= 0, F.col("k") % 7))).first()[0]
    assert plan.toRdd().count() == joined.count() and "skew=true" in plan.executedPlan().toString()


@pytest.mark.parametrize("copies", [32, 1])
def test_a_side_beyond_the_bound_is_not_broadcast(spark, monkeypatch, copies):
    fact, dim = (materialise(spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 2).alias(v)), v) for n, v in ((100, "x"), (60, "y")))
    monkeypatch.setattr(skew, "SALTED_ROWS", 60 * copies)
    joined = skew.lookup_join(fact, dim, ["k"], "inner", max_rows=50)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert rows(joined, "k", "x", "y") == rows(fact.where("k < 60").withColumn("y", F.col("x")), "k", "x", "y")


def test_first_per_key_keeps_the_smallest(spark):
    df = spark.createDataFrame(
        [(1, "b", 5, None), (1, "a", 9, "x"), (2, "c", 1, "y"), (2, "c", 0, "z")], "k int, f string, v int, t string"
    )
    out = skew.first_per_key(df, ["k"], [F.col("f"), F.col("v")])
    assert rows(out, *df.columns) == [(1, "a", 9, "x"), (2, "c", 0, "z")]


def test_exact_quantiles_by_narrowing(spark):
    rng = np.random.default_rng(5)
    values = {
        "a": rng.normal(0, 1, 4000),
        "b": np.concatenate([np.full(3000, 7.0), rng.exponential(1e6, 1000)]),  # three quarters are one value
        "c": rng.integers(-3, 4, 4000).astype(float),
        "d": np.concatenate([[1e300, -1e300], rng.uniform(0, 1e-9, 3998)]),
    }
    rows = list(zip(*[v.tolist() for v in values.values()], strict=True))
    rows += [(float("nan"), None, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    ps = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]
    slow = exact_quantiles(df, list(values), ps, direct_rows=0)
    fast = exact_quantiles(df, list(values), ps)
    for name in values:
        clean = [r["abcd".index(name)] for r in rows]
        clean = np.array([x for x in clean if x is not None and not np.isnan(x)])
        assert slow[name] == pytest.approx(np.quantile(clean, ps).tolist(), rel=1e-12, abs=1e-12)
        assert fast[name] == pytest.approx(slow[name], rel=1e-12, abs=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "a double")
    assert exact_quantiles(df, ["a"], [0.5]) == {"a": [None]}
    assert exact_quantiles(df, ["a"], [0.5], direct_rows=0) == {"a": [None]}


@pytest.mark.parametrize("rows_back", [1, 5, 17, 40, 5000])
def test_block_moments_equal_plain_frames(spark, hot, rows_back, monkeypatch):
    from tillwatch.plans import rolling

    monkeypatch.setattr(rolling, "PLAIN_ROWS", 0)  # blocks for every frame length
    df = hot.withColumn("y", (F.col("id") * 7919 % 1009 * 1000.0)).withColumn("x", skew.micros("ts") / 1e6 - 1.7e9)
    order = Window.partitionBy("k").orderBy("ts", "id")
    before, upto = order.rowsBetween(-rows_back, -1), order.rowsBetween(-rows_back, 0)
    plain = df.withColumn("s", F.stddev_samp("y").over(before)).withColumn("b", F.regr_slope("y", "x").over(upto))
    cut = rolling.with_preceding_moments(df, "k", ["ts", "id"], "y", rows_back, "m", "x")
    here = rolling.including_current(F.col("m"), "y", "x")
    cut = cut.withColumn("s", rolling.sample_deviation(F.col("m"))).withColumn("b", rolling.slope(here))
    for a, e in zip(rows(cut, "id", "s", "b"), rows(plain, "id", "s", "b"), strict=True):
        assert a.id == e.id and (a.s is None) == (e.s is None) and (a.b is None) == (e.b is None)
        assert a.s is None or a.s == pytest.approx(e.s, rel=1e-9, abs=1e-6)
        assert a.b is None or a.b == pytest.approx(e.b, rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("seconds", [1, 60, 3600, 86400 * 400])
def test_moments_since_equal_plain_ranges(spark, hot, seconds):
    from tillwatch.plans import rolling

    df = hot.withColumn("y", (F.col("id") * 7919 % 1009 * 1000.0)).withColumn("x", skew.micros("ts") / 1e6 - 1.7e9).withColumn("t", skew.micros("ts"))
    order = Window.partitionBy("k").orderBy("t")
    before = order.rangeBetween(-seconds * 1_000_000, -1)
    plain = df.withColumn("s", F.stddev_samp("y").over(before)).withColumn("n", F.count("y").over(before)).withColumn("b", F.regr_slope("y", "x").over(before))
    cut = rolling.with_moments_since(df, ["k"], "ts", "y", seconds, "m", "x")
    assert set(cut.columns) == {*df.columns, "m"}
    cut = cut.withColumn("s", rolling.sample_deviation(F.col("m"))).withColumn("n", F.coalesce("m.n", F.lit(0))).withColumn("b", rolling.slope(F.col("m")))
    for a, e in zip(rows(cut, "id", "s", "n", "b"), rows(plain, "id", "s", "n", "b"), strict=True):
        assert a.id == e.id and a.n == e.n and (a.s is None) == (e.s is None) and (a.b is None) == (e.b is None)
        assert a.s is None or a.s == pytest.approx(e.s, rel=1e-9, abs=1e-6)
        assert a.b is None or a.b == pytest.approx(e.b, rel=1e-6, abs=1e-6)


def test_moments_since_without_time_and_with_gaps(spark):
    import datetime as dt

    from tillwatch.plans import rolling

    day = dt.datetime(2024, 1, 1)
    data = [(1, day, 1.0), (1, day, 3.0), (1, day + dt.timedelta(hours=1), 5.0), (1, day + dt.timedelta(hours=2), None), (1, day + dt.timedelta(days=9), 7.0), (1, None, 9.0), (None, day, 2.0)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], "k int, ts timestamp_ntz, y double, id int")
    got = {r.id: r.m and (r.m.n, r.m.my) for r in rolling.with_moments_since(df, ["k"], "ts", "y", 3600, "m").collect()}
    assert got == {0: (0, None), 1: (0, None), 2: (2, 2.0), 3: (1, 5.0), 4: (0, None), 5: None, 6: (0, None)}
