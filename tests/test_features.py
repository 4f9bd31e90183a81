"""Machine, bucket and transaction features with default frames, against pandas on dense rows."""

import datetime as dt
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillwatch.functions.numbers import regression_p_values
from tillwatch.operators import behaviour, rollup, transactions
from tillwatch.operators.buckets import bucket_features
from tillwatch.operators.machine_profile import machine_profile

START = dt.datetime(2024, 1, 28)
ROLLUP = (
    "cod_terminal int, bucket_15min timestamp_ntz, tipo_operacion string, num_transacciones long,"
    " monto_total_dispensado double"
)


@pytest.fixture(scope="module")
def dense():
    """Machine 1: 900 buckets without a gap, rising; machine 2: constant; machine 3: one row; machine 4: six rows."""
    rng = np.random.default_rng(1)
    rows = [
        (1, START + dt.timedelta(minutes=15 * i), "Retiro", int(rng.integers(1, 5)), float(rng.integers(1, 5000) * 100 + i * 50))
        for i in range(900)
    ]
    rows += [(2, START + dt.timedelta(minutes=15 * i), "Retiro", 1, 700.0) for i in range(20)]
    rows += [(3, START, "Avance", 1, 500.0)]
    rows += [(4, START + dt.timedelta(hours=i), "Avance", 1, float(v)) for i, v in enumerate([1, 3, 2, 5, 4, 6])]
    return rows


@pytest.fixture(scope="module")
def profile(spark, dense):
    rows = machine_profile(spark.createDataFrame(dense, ROLLUP).repartition(5)).collect()
    return {r.cod_cajero: r for r in rows}


def test_basic_against_pandas(dense, profile):
    x = pd.Series([r[4] for r in dense if r[0] == 1])
    got = profile["1"]
    assert got.dispensacion_promedio == pytest.approx(x.mean())
    assert got.dispensacion_std == pytest.approx(x.std())
    assert (got.dispensacion_mediana, got.q25, got.q75) == pytest.approx(tuple(x.quantile([0.5, 0.25, 0.75])))
    assert got.coef_variacion == pytest.approx(x.std() / x.mean())
    assert (got.num_periodos_15min, got.fecha_primer_dato) == (900, START)


def test_trend_against_pandas(dense, profile):
    x = pd.Series([r[4] for r in dense if r[0] == 1])
    t = np.arange(900)
    got = profile["1"]
    assert got.tendencia_slope == pytest.approx(np.polyfit(t, x, 1)[0])
    assert got.tendencia_r2 == pytest.approx(np.corrcoef(t, x)[0, 1] ** 2)
    rolling = x.rolling(672, min_periods=1).std()
    assert got.volatilidad_reciente == pytest.approx(rolling.iloc[-1])
    assert got.volatilidad_promedio == pytest.approx(rolling.mean())
    last, before = x.iloc[-672:].mean(), x.iloc[:-672].mean()
    assert got.cambio_reciente_pct == pytest.approx((last - before) / before * 100)


def test_time_and_history_against_pandas(dense, profile):
    df = pd.DataFrame([r for r in dense if r[0] == 1], columns=["k", "t", "o", "n", "x"])
    hours = df.groupby(df.t.dt.hour).x
    got = profile["1"]
    assert got.hora_pico == hours.mean().idxmax()
    assert got.dispensacion_hora_pico == pytest.approx(hours.mean().max())
    assert got.std_por_hora == pytest.approx(hours.std().mean())
    weekend = df.t.dt.dayofweek >= 5
    assert got.ratio_fds_laboral == pytest.approx(df.x[weekend].mean() / df.x[~weekend].mean())
    z = ((df.x - df.x.mean()) / df.x.std()).abs()
    assert got.anomalias_2std == (z > 2).sum()
    assert got.max_z_score_historico == pytest.approx(z.max())


def test_constant_machine(profile):
    got = profile["2"]
    assert (got.dispensacion_std, got.coef_variacion, got.max_z_score_historico) == (0, 0, 0)
    assert (got.tendencia_slope, got.tendencia_r2, got.tendencia_pvalue) == (0, 0, 1)
    assert got.hora_pico == 0  # all hours are equal: the lowest


def test_machine_with_one_row(profile):
    got = profile["3"]
    assert got.dispensacion_std is None and got.volatilidad_reciente is None and got.std_por_hora is None
    assert (got.tendencia_slope, got.tendencia_pvalue, got.anomalias_3std, got.cambio_reciente_pct) == (0, 1, 0, 0)
    assert (got.disp_madrugada, got.disp_noche, got.disp_laboral, got.ratio_fds_laboral) == (500, 0, 0, 1)


def test_six_rows_have_a_trend(profile):
    got = profile["4"]
    assert got.tendencia_slope == pytest.approx(np.polyfit(range(6), [1, 3, 2, 5, 4, 6], 1)[0])
    r = 31 / 35  # over six points; with four degrees of freedom the tail has a closed form
    assert got.tendencia_pvalue == pytest.approx(1 - r * (1.5 - 0.5 * r * r), rel=1e-9)


def test_p_values():
    # Two-sided t-test values worked out independently: one degree of freedom is Cauchy, two have a closed form.
    r = np.array([0.0, 1.0, -1.0, 0.5, 0.5, -0.5, 1e-9])
    n = np.array([10.0, 10.0, 10.0, 3.0, 4.0, 4.0, 1e6])
    got = regression_p_values(r, n)
    t1 = 0.5 / np.sqrt(0.75)
    one = 1 - 2 / np.pi * np.arctan(t1)
    t2 = 0.5 * np.sqrt(2 / 0.75)
    two = 1 - t2 / np.sqrt(2 + t2**2)
    assert got == pytest.approx([1, 0, 0, one, two, two, 1], abs=1e-5)
    big = regression_p_values(np.array([0.05]), np.array([10_000.0]))[0]
    assert big == pytest.approx(5.6e-7, rel=0.05)


def test_bucket_features_with_default_frames(spark, dense):
    df = spark.createDataFrame([r for r in dense if r[0] == 1], ROLLUP)
    totals = rollup.bucket_totals(df, with_baseline=True)
    got = bucket_features(totals).orderBy("bucket_15min").toPandas()
    x = got.monto_total_dispensado
    assert got.cambio_vs_ayer.to_numpy() == pytest.approx((x.pct_change(96) * 100).fillna(0).to_numpy())
    assert got.volatilidad_reciente.iloc[200] == pytest.approx(x.iloc[104:200].std())
    seconds = np.arange(900) * 900.0
    assert got.tendencia_24h.iloc[500] == pytest.approx(np.polyfit(seconds[404:501] - seconds[404], x.iloc[404:501], 1)[0])
    assert np.isnan(got.tendencia_24h.iloc[0])
    same_hour = got[got.hora_del_dia == got.hora_del_dia.iloc[800]]
    at = same_hour.index.get_loc(800)
    past = same_hour.monto_total_dispensado.iloc[max(0, at - 28) : at]
    assert got.z_score_vs_hora.iloc[800] == pytest.approx((x.iloc[800] - past.mean()) / past.std())
    assert got.z_score_vs_hora.iloc[0] == 0
    january = got[got.mes == 1].monto_total_dispensado
    rank = (january.rank(method="min") - 1) / (len(january) - 1) * 100
    assert got[got.mes == 1].percentil_vs_mes.to_numpy() == pytest.approx(rank.to_numpy())
    history = bucket_features(totals, baseline="history").orderBy("bucket_15min").toPandas()
    assert history.tendencia_24h.isna().sum() == 9
    with pytest.raises(ValueError):
        bucket_features(totals, baseline="other")


def test_baseline_in_place_equals_join(spark, dense):
    df = spark.createDataFrame(dense, ROLLUP)
    joined = bucket_features(rollup.bucket_totals(df), machine_profile(df, ("basic",)))
    placed = bucket_features(rollup.bucket_totals(df, with_baseline=True))
    key = ["cod_terminal", "bucket_15min"]
    a = joined.select(*key, F.round("z_score_vs_cajero", 9)).orderBy(*key).collect()
    assert a == placed.select(*key, F.round("z_score_vs_cajero", 9)).orderBy(*key).collect()


def test_calendar_edges(spark):
    days = [dt.datetime(2024, 2, d, h) for d, h in ((1, 0), (2, 6), (13, 5), (14, 22), (16, 23), (17, 7), (28, 12), (29, 21))]
    df = spark.createDataFrame([(1, d, "Retiro", 1, 1.0) for d in days], ROLLUP)
    rows = bucket_features(rollup.bucket_totals(df, True)).orderBy("bucket_15min").collect()
    assert [r.es_quincena for r in rows] == [True, False, False, True, True, False, False, True]
    assert [r.es_fin_de_mes for r in rows] == [False] * 6 + [True, True]
    assert [r.dia_semana for r in rows] == [d.isoweekday() for d in days]


TX = (
    "id_tlf long, fecha_transaccion timestamp_ntz, cod_terminal int, tipo_operacion string, cod_estado_transaccion int,"
    " valor_transaccion double, valor_transaccion_original double, fecha_negocio date"
)


def tx(spark, rows):
    full = [(i, START + dt.timedelta(seconds=s), k, o, e, v, v, START.date()) for i, (s, k, o, e, v) in enumerate(rows)]
    return spark.createDataFrame(full, TX)


def test_transaction_features(spark):
    df = tx(
        spark,
        [
            (0, 1, "Retiro", 1, 2_000_000.0),
            (9, 1, "Retiro", 2, 1_999_999.0),
            (19, 1, "Depositos", 1, 9e6),
            (19, 1, "Otro", None, None),
            (5, 2, "Cambio De Pin", 1, 0.0),
        ],
    )
    machines = spark.createDataFrame([("1", True, None)], "codigo string, cajero_adyacente_oficina boolean, cierre_nocturno boolean")
    got = {r.id_transaccion: r for r in transactions.transaction_features(df, machines).collect()}
    assert [got[i].es_retiro_maximo for i in range(5)] == [True, False, False, False, False]
    assert [got[i].tiempo_desde_anterior_seg for i in range(5)] == [None, 9.0, 10.0, 0.0, None]
    assert [got[i].es_transaccion_rapida for i in range(5)] == [False, True, False, True, False]
    assert [got[i].tipo_operacion_encoded for i in range(5)] == [3, 3, 4, 0, 1]
    assert got[0].tasa_rechazo_cajero == 0.25 and got[0].velocidad_promedio_cajero == pytest.approx(19 / 3)
    assert (got[0].cajero_adyacente_encoded, got[0].cierre_nocturno_encoded, got[4].cajero_adyacente_encoded) == (1, 0, 0)
    assert got[4].velocidad_promedio_cajero is None and got[4].desviacion_monto_cajero is None


def test_sequence_rules(spark):
    rows = [(i * 700, 1, "Cambio De Pin", 1, 0.0) for i in range(7)]  # the sixth is 3500 s after the first
    rows += [(i, 2, "Retiro", 2, 1.0) for i in range(11)] + [(11, 2, "Retiro", 1, 1.0), (12, 2, "Retiro", 2, 1.0)]
    rows += [(0, 3, "Cambio De Pin", 1, 0.0), (299, 3, "Retiro", 1, 1.2e6), (300, 3, "Avance", 1, 0.9e6)]
    df = tx(spark, rows)
    assert {r.id_tlf: r.cambios_pin for r in behaviour.frequent_pin_changes(df).collect()} == {5: 6, 6: 6}
    assert [(r.cod_terminal, r.rechazos) for r in behaviour.rejection_runs(df).collect()] == [(2, 11)]
    assert [r.transacciones_periodo for r in behaviour.high_rate(df).orderBy("id_tlf").collect()] == [11, 12, 13]
    assert [r.segundos_desde_pin for r in behaviour.withdrawal_after_pin_change(df).collect()] == [299.0]
    assert [r.monto_periodo for r in behaviour.large_withdrawals(df).collect()] == [2.1e6]


def test_rule_scores_equal_the_single_rules(spark):
    draw = random.Random(4)
    kinds = ["Retiro", "Avance", "Cambio De Pin", "Depositos", None]
    rows = [(draw.randrange(9000) * 2, draw.choice([1, 1, 1, 2, None]), draw.choice(kinds), draw.choice([1, 2, 2, 2, None]), draw.choice([None, 1e5, 9e5])) for _ in range(700)]
    df = tx(spark, rows)
    df = df.unionByName(df.filter("id_tlf < 3").withColumn("id_tlf", F.col("id_tlf") + 9000).withColumn("fecha_transaccion", F.lit(None).cast("timestamp_ntz")))
    machines = spark.createDataFrame([("1", "10:30", "18:00")], "codigo string, hora_apertura_atm string, hora_cierre_atm string")
    limits = {"cambios_pin": {"more_than": 2}, "velocidad": {"more_than": 4}, "rechazos": {"at_least": 3}, "pin_y_retiro": {"seconds": 400}}
    single = {
        "cambios_pin": behaviour.frequent_pin_changes(df, 2),
        "retiro_grande": behaviour.large_withdrawals(df),
        "velocidad": behaviour.high_rate(df, 4),
        "pin_y_retiro": behaviour.withdrawal_after_pin_change(df, 400),
        "fuera_de_horario": behaviour.outside_hours(df, machines),
    }
    want = {r.id_tlf: set() for r in df.collect()}
    for name, found in single.items():
        hits = [r.id_tlf for r in found.collect()]
        assert hits
        for i in hits:
            want[i].add(name)
    runs = behaviour.rejection_runs(df, 3).collect()
    for r in df.filter("cod_estado_transaccion = 2").collect():
        if r.fecha_transaccion and any(r.cod_terminal is not None and r.cod_terminal == q.cod_terminal and q.desde <= r.fecha_transaccion <= q.hasta for q in runs):
            want[r.id_tlf].add("rechazos")
    assert runs
    got = {r.id_transaccion: r for r in behaviour.rule_scores(df, machines, **limits).collect()}
    assert {i: r.reglas for i, r in got.items()} == {i: sorted(names) for i, names in want.items()}
    assert all(r.score_reglas == max([behaviour.RULE_SCORES[n] for n in r.reglas], default=0.0) for r in got.values())
    plan = behaviour.rule_scores(df, machines)._jdf.queryExecution().optimizedPlan().toString()
    assert "fecha_transaccion#" in plan and not re.search(r"Join .*<=|Join .*>=", plan)


def test_one_exchange_for_all_bucket_windows(spark, dense):
    df = spark.createDataFrame(dense, ROLLUP)
    plan = bucket_features(rollup.bucket_totals(df, with_baseline=True))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    plan = machine_profile(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 4


def test_pattern_function(spark):
    rows = [("7", START + dt.timedelta(hours=h), 2 + h % 4, float(h)) for h in range(24)]
    df = spark.createDataFrame(rows, "cod_cajero string, fecha_hora timestamp_ntz, cod_admin_efectivo int, monto_total double")
    rollup.register_pattern_function(spark, df)
    whole = spark.sql("SELECT * FROM get_patron_cajero('7')").first()
    assert whole == rollup.machine_pattern(df, "7").first()
    hour = spark.sql("SELECT * FROM get_patron_cajero('7', 5)").first()
    assert hour == rollup.machine_pattern(df, "7", 5).first()
    assert spark.sql("SELECT * FROM get_patron_cajero('8')").first().num_transacciones == 0


def test_transaction_features_take_few_jobs_and_two_passes(spark):
    from catalog import tables
    from tillwatch.session import materialise

    fact = materialise(tables.transactions(spark, "/root/testdata/sf0.001"), "fact")
    machines = materialise(tables.machines(spark, "/root/testdata/sf0.001"), "machines")
    spark.sparkContext.setJobGroup("few", "features")
    try:
        rows = transactions.transaction_features(fact, machines)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) <= 16
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert sum("id_tlf" in line for line in plan.splitlines() if "Relation [" in line) == 1  # the other pass is in the table of hours
