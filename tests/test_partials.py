"""States of days: any split adds up to the whole, and a new day needs no other input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from catalog import tables
from tillwatch.operators import partials, rollup
from tillwatch.operators.machine_profile import machine_profile
from tillwatch.plans import jobs
from tillwatch.session import prepare, work_dir
from tillwatch.sources.tables import finish_switch, read_table, remove, replace_table, switch_table

SF = "/root/testdata/sf0.001"


def table(df, key, digits=4):
    numbers = [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in sorted(df.dtypes)]
    return {r[key]: r for r in df.select(*numbers).collect()}


def test_days_in_any_order_add_up(spark):
    rows = [(1, dt.datetime(2024, 1, d, h, m), 1e9 + a) for d, h, m, a in [(1, 5, 0, 3.0), (1, 5, 15, 9.0), (1, 23, 45, 1.0), (3, 0, 0, 7.5), (6, 12, 0, 2.0), (7, 12, 0, 8.0), (7, 13, 0, 4.0)]]
    rows += [(2, dt.datetime(2024, 1, 1), 5.0), (3, dt.datetime(2024, 1, 2), None)]
    df = spark.createDataFrame([(*r, 1, "Retiro") for r in rows], "cod_terminal int, bucket_15min timestamp_ntz, monto_total_dispensado double, num_transacciones long, tipo_operacion string")
    got = table(partials.profile_of(partials.rollup_states(df.repartition(5))).drop(*partials.ESTIMATES), "cod_cajero")
    want = table(machine_profile(df), "cod_cajero")
    for machine, row in got.items():
        for c in row.asDict():
            if machine != "3" or c not in ("tendencia_slope", "tendencia_r2", "tendencia_pvalue", "max_z_score_historico"):
                assert row[c] == want[machine][c], (machine, c)
    assert got["1"].tendencia_slope != 0


@pytest.fixture(scope="module")
def base(spark):
    prepare(spark)
    base = work_dir(spark, "warehouse")
    replace_table(tables.machines(spark, SF), base, jobs.MACHINES)
    replace_table(jobs.by_day(tables.transactions(spark, SF), "fecha_transaccion"), base, jobs.FACT, ["dia"])
    return base


def test_a_new_day_reads_only_itself(spark, base):
    fact = tables.transactions(spark, SF)
    last, old = dt.date(2024, 1, 30), dt.date(2024, 1, 10)
    early = fact.filter(F.to_date("fecha_transaccion") < F.lit(last))
    replace_table(jobs.by_day(early, "fecha_transaccion"), base, jobs.FACT, ["dia"])
    jobs.build_history(spark, base)
    jobs.build_states(spark, base)
    for name in (jobs.FACT, jobs.ROLLUP):  # an old day goes: if it were read, its rows would be missing
        remove(spark, f"{base}/{name}/dia={old}")
    new = fact.filter(F.to_date("fecha_transaccion") == F.lit(last))
    jobs.by_day(new, "fecha_transaccion").write.mode("append").partitionBy("dia").parquet(f"{base}/{jobs.FACT}")
    jobs.update_history(spark, base, [last])
    got = table(read_table(spark, base, jobs.PROFILE).select("cod_cajero", "dispensacion_promedio", "dispensacion_std", "num_periodos_15min", "tendencia_slope", "hora_pico"), "cod_cajero")
    whole = machine_profile(rollup.rollup_transactions(fact))
    want = table(whole.select("cod_cajero", "dispensacion_promedio", "dispensacion_std", "num_periodos_15min", "tendencia_slope", "hora_pico"), "cod_cajero")
    assert got == want
    stored = table(read_table(spark, base, jobs.SUMMARY), "cod_cajero")
    summary = table(rollup.machine_summary(fact).withColumn("cod_cajero", F.col("cod_terminal").cast("string")), "cod_cajero")
    assert stored.keys() == summary.keys()
    assert all(stored[m].total_transacciones == summary[m].total_transacciones and stored[m].dispensacion_std == summary[m].dispensacion_std for m in stored)


def test_a_day_without_rows_is_emptied(spark, base):
    jobs.update_history(spark, base, [dt.date(2024, 1, 10)])  # its input is gone by now
    assert read_table(spark, base, jobs.ROLLUP_STATES).filter("dia = '2024-01-10'").count() == 0


def test_a_switch_that_stopped_is_finished(spark):
    base, one, two = work_dir(spark, "base"), spark.range(3), spark.range(5)
    switch_table(one, base, "t")
    assert read_table(spark, base, "t").count() == 3
    switch_table(read_table(spark, base, "t").union(one), base, "t")  # made from itself
    assert read_table(spark, base, "t").count() == 6
    two.write.parquet(f"{base}/t_pendiente")  # complete, but not in its place
    finish_switch(spark, base, "t")
    assert read_table(spark, base, "t").count() == 5
    one.write.parquet(f"{base}/t_pendiente")
    remove(spark, f"{base}/t_pendiente/_SUCCESS")  # not complete
    finish_switch(spark, base, "t")
    assert read_table(spark, base, "t").count() == 5
