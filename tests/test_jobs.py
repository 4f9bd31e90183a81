"""The three jobs end to end on files derived from the given tables."""

import pytest
from pyspark.sql import functions as F

from catalog import ingest, tables
from tillwatch.plans import jobs
from tillwatch.schemas import MACHINE_HEADINGS
from tillwatch.session import work_dir
from tillwatch.sources.tables import read_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base(spark):
    from tillwatch.session import prepare

    prepare(spark)
    base, master = work_dir(spark, "warehouse"), work_dir(spark, "master")
    m = tables.machines(spark, SF).withColumnRenamed("municipio_dane", "municipio")
    known = [F.col(new).cast("string").alias(old) for old, new in MACHINE_HEADINGS.items() if new in m.columns]
    m.select(*known).write.option("header", True).csv(master)
    jobs.load_machines(spark, master, base)
    extract = ingest.write_extract(spark, SF)
    folder = spark.read.option("header", True).option("recursiveFileLookup", True)
    flat = work_dir(spark, "flat")
    for month in ingest.months(spark, SF):  # month folders without sub-folders
        folder.csv(f"{extract}/{month}").write.option("header", True).csv(f"{flat}/{month}")
    errors, counts = jobs.load_extracts(spark, flat, [*ingest.months(spark, SF), "2024/09"], base)
    assert [r.mes_origen for r in errors.collect()] == ["2024/09"]
    assert counts["omitidos"] == 0 and counts["insertados"] > 0
    jobs.build_history(spark, base)
    return base


def test_history(spark, base):
    profile = read_table(spark, base, jobs.PROFILE)
    machines = read_table(spark, base, jobs.FACT).filter("cod_estado_transaccion = 1").select("cod_terminal").distinct()
    assert profile.count() == machines.count()
    assert len(profile.columns) == 45
    before = profile.count()
    jobs.build_history(spark, base)  # again: merged, not doubled
    assert read_table(spark, base, jobs.SUMMARY).count() == before


def test_buckets_to_alerts(spark, base):
    forest = jobs.detect_on_buckets(spark, base, contamination=0.05, trees=30)
    alerts = read_table(spark, base, jobs.ALERTS)
    buckets = read_table(spark, base, jobs.BUCKETS)
    flagged = forest.transform(buckets).filter("es_anomalia").count()
    assert alerts.count() == flagged > 0
    jobs.detect_on_buckets(spark, base, contamination=0.05, trees=30)
    assert read_table(spark, base, jobs.ALERTS).count() == flagged


def test_transactions_to_reasons(spark, base):
    jobs.build_transaction_features(spark, base)
    loose = {"retiro_grande": {"seconds": 6 * 3600}, "velocidad": {"more_than": 1, "seconds": 12 * 3600}, "rechazos": {"at_least": 2}}
    jobs.score_transactions(spark, base, trees=20, **loose)
    scores = read_table(spark, base, jobs.SCORES)
    assert scores.count() == read_table(spark, base, jobs.FACT).count()
    assert scores.filter("score_reglas = 1").count() > 0 and scores.filter("nivel_anomalia <> 'Normal'").count() > 0
    assert scores.filter("score_final <> 0.5 * score_reglas + 0.5 * score_isolation_forest").count() == 0
    jobs.build_reasons(spark, base)
    reasons = read_table(spark, base, jobs.REASONS)
    assert {r.tipo_razon for r in reasons.select("tipo_razon").distinct().collect()} <= {
        "temporal", "monto", "velocidad", "operacion", "ubicacion", "ml", "otro"
    }


def test_files_to_alerts(spark, base):
    jobs.fit_machine_model(spark, base, trees=30)
    query = jobs.watch(spark, base, ingest.write_quarter_files(spark, SF), once=True)
    query.awaitTermination()
    alerts = read_table(spark, base, f"{jobs.ALERTS}_15min")
    assert alerts.filter("score_anomalia < 0.5 OR score_anomalia >= 0.84").count() == 0


def test_days_that_are_not_asked_for_are_not_read(spark, base):
    for name in (jobs.ROLLUP, jobs.TRANSACTIONS, jobs.BUCKETS):
        rows = jobs.read_days(spark, base, name, "2024-01-05", "2024-01-06")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(dia" in plan
        assert {str(r.dia) for r in rows.select("dia").distinct().collect()} == {"2024-01-05", "2024-01-06"}
