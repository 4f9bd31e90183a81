import hashlib

import pytest
from pyspark.sql import functions as F

from tillwatch.plans.strata import quotas, stratified_sample


def brute(rows, size, seed=42):
    """rows: (a, b, id). Shares rounded on their running sum, smallest hashes first."""
    strata = {}
    for a, b, i in rows:
        strata.setdefault((a is not None, a, b is not None, b), []).append(i)
    total, size, before, out = len(rows), min(size, len(rows)), 0, set()
    for key in sorted(strata, key=lambda k: tuple(repr(x) if isinstance(x, str) else (x if x is not None else -1) for x in k)):
        own = sorted(strata[key], key=lambda i: hashlib.md5(f"{seed}|{i}".encode()).hexdigest()[:15])
        n = (before + len(own)) * size // total - before * size // total
        before += len(own)
        out |= set(own[:n])
    return out


@pytest.mark.parametrize("size", [1, 37, 500, 3999, 10_000])
def test_exact_sizes_with_a_hot_stratum(spark, size):
    rows = [(1, 7, i) for i in range(3000)] + [(i % 3, i % 11, 10_000 + i) for i in range(990)] + [(None, None, 20_000 + i) for i in range(10)]
    df = spark.createDataFrame(rows, "a int, b int, id int").repartition(7)
    got = [r.id for r in stratified_sample(df, ["a", "b"], ["id"], size).collect()]
    assert len(got) == len(set(got)) == min(size, len(rows))
    assert set(got) == brute(rows, size)
    assert set(got) == {r.id for r in stratified_sample(df.coalesce(2), ["a", "b"], ["id"], size).collect()}


def test_nothing_and_repeated_keys(spark):
    df = spark.createDataFrame([(1, 1, 5)] * 4 + [(1, 1, 6)], "a int, b int, id int")
    assert stratified_sample(df.limit(0), ["a", "b"], ["id"], 10).count() == 0
    got = sorted(r.id for r in stratified_sample(df, ["a", "b"], ["id"], 2).collect())
    assert got in ([5, 5, 5, 5], [5, 5, 5, 5, 6], [6, 5, 5, 5, 5])
    assert stratified_sample(df, ["a", "b"], ["id"], 0).count() == 0


def test_quotas_add_up(spark):
    sizes = spark.createDataFrame([(1, i, 10**12 + i) for i in range(50)] + [(2, 0, 1)], "a int, b int, n long")
    found = quotas(sizes, ["a", "b"], 1_000_003).agg(F.sum("cupo"), F.min("cupo"), F.max("cupo")).first()
    assert found[0] == 1_000_003 and found[2] - 20_000 <= 1
