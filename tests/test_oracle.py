"""Every registered query against its SQL, or at least against being empty."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    if name in ORACLE:
        assert differences(df, con, ORACLE[name]) == []
    else:
        assert df.columns and df.count() >= 0


def test_every_oracle_has_its_query():
    assert set(ORACLE) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5
    assert [r.z_score_vs_cajero for r in rows] == sorted((r.z_score_vs_cajero for r in rows), reverse=True)
