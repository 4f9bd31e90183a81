"""Thresholds and texts of alerts, rules and reasons on hand-made rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tillwatch.operators import alerts, reasons, rules
from tillwatch.operators.behaviour import outside_hours


@pytest.mark.parametrize(
    "score, z, expected",
    [
        (80, 4, "critico"),
        (80, 3.99, "alto"),
        (79.9, 4, "alto"),
        (85, 0, "critico"),
        (0, -5, "critico"),
        (0, -4.9, "alto"),
        (70, 0, "alto"),
        (69.9, 2.9, "medio"),
        (0, -3, "alto"),
    ],
)
def test_severity(spark, score, z, expected):
    df = spark.createDataFrame([(float(score), float(z))], "s double, z double")
    assert df.select(alerts.severity(F.col("s"), F.col("z"))).first()[0] == expected


def test_expected_amount(spark):
    df = spark.createDataFrame([(100.0, 0.0), (100.0, 1.0), (100.0, -1.0), (100.0, -2.0)], "x double, z double")
    got = [r[0] for r in df.select(alerts.expected_amount(F.col("x"), F.col("z"))).collect()]
    assert got == [100.0, 50.0, None, -100.0]


FEATURES = (
    "cod_terminal int, bucket_15min timestamp_ntz, monto_total_dispensado double, hora_del_dia int, dia_semana int,"
    " es_fin_de_semana boolean, es_quincena boolean, z_score_vs_cajero double, z_score_vs_hora double,"
    " z_score_vs_dia_semana double, percentil_vs_mes double, cambio_vs_anterior double, score_anomalia double"
)
AT = dt.datetime(2024, 1, 6, 9, 15)


def bucket(spark, **changes):
    row = dict(
        cod_terminal=7,
        bucket_15min=AT,
        monto_total_dispensado=1234567.0,
        hora_del_dia=9,
        dia_semana=6,
        es_fin_de_semana=True,
        es_quincena=False,
        z_score_vs_cajero=0.0,
        z_score_vs_hora=0.0,
        z_score_vs_dia_semana=0.0,
        percentil_vs_mes=0.0,
        cambio_vs_anterior=0.0,
        score_anomalia=0.0,
    )
    row.update(changes)
    return alerts.build_alerts(spark.createDataFrame([tuple(row.values())], FEATURES)).first()


def test_reason_text_without_reason(spark):
    assert bucket(spark).razones == "Anomalia detectada por modelo"
    assert bucket(spark, z_score_vs_hora=None, percentil_vs_mes=None).razones == "Anomalia detectada por modelo"


def test_reason_text_with_all(spark):
    row = bucket(
        spark,
        z_score_vs_cajero=-3.0,
        z_score_vs_hora=3.456,
        z_score_vs_dia_semana=-2.5,
        percentil_vs_mes=95.0,
        cambio_vs_anterior=1234.56,
        score_anomalia=70.0,
    )
    assert row.razones == (
        "Z-score vs cajero: -3.00 std | Z-score vs misma hora: 3.46 std | Z-score vs mismo dia: -2.50 std"
        " | Percentil mensual: 95.0% | Cambio vs anterior: +1234.6% | Isolation Forest: 70/100"
    )


def test_description(spark):
    row = bucket(spark, z_score_vs_cajero=1.0, es_quincena=True)
    assert row.descripcion == (
        "Dispensacion: $1,234,567 (+100.0% vs esperado) | Sabado 09:XX | Z-score: 1.00 std | Fin de semana | Quincena"
    )
    low = bucket(spark, z_score_vs_cajero=-1.0, es_fin_de_semana=False, dia_semana=9)
    assert low.monto_esperado is None
    assert low.descripcion == "Dispensacion: $1,234,567 (+0.0% vs esperado) | Dia desconocido 09:XX | Z-score: -1.00 std"


def test_severity_rank_is_not_alphabetical(spark):
    df = spark.createDataFrame([("medio",), ("critico",), ("alto",), ("Crítico",), ("?",)], "severidad string")
    assert [r[0] for r in df.select(alerts.severity_rank()).collect()] == [1, 3, 2, 3, 0]


# -- rules ---------------------------------------------------------------------------------------------------

PROFILE = (
    "amount double, hour int, dispensacion_promedio double, dispensacion_std double, disp_madrugada double,"
    " ratio_vs_zona double, pct_anomalias_3std double"
)


def fire(spark, amount=100.0, hour=12, mean=100.0, std=10.0, dawn=100.0, zone=1.0, pct=0.0):
    df = spark.createDataFrame([(amount, hour, mean, std, dawn, zone, pct)], PROFILE)
    r = df.select(rules.business_rules(F.col("amount"), F.col("hour")).alias("r")).first().r
    return r.score, {x.regla[:7]: (x.score_parcial, x.texto) for x in r.reglas}


def test_no_rule(spark):
    assert fire(spark) == (0.0, {})


def test_extreme_amount(spark):
    assert fire(spark, amount=130.0)[1] == {}  # exactly three deviations
    score, fired = fire(spark, amount=150.0)
    assert score == pytest.approx(0.30 * 0.5)
    assert fired["regla_1"][1] == "Dispensación extrema: $150 (5.0σ del promedio $100)"
    assert fire(spark, amount=1e6, std=0.0)[1].keys() == {"regla_3"}
    assert fire(spark, amount=290.0)[0] == pytest.approx(0.30)  # capped


def test_suspicious_hour(spark):
    assert fire(spark, hour=5, dawn=9.0)[0] == pytest.approx(0.25)
    assert fire(spark, hour=5, dawn=10.0)[0] == 0
    assert fire(spark, hour=6, dawn=0.0)[0] == 0
    assert fire(spark, amount=0.0, hour=0, mean=0.0, std=0.0)[1].keys() == {"regla_2"}


def test_drastic_change(spark):
    assert fire(spark, amount=300.0, std=1000.0)[0] == 0  # exactly 200 %
    score, fired = fire(spark, amount=350.0, std=1000.0)
    assert score == pytest.approx(0.20 * 0.5)
    assert fired["regla_3"][1] == "Cambio drástico: aumento de 250%"


def test_history_and_zone(spark):
    assert fire(spark, pct=5.0)[0] == 0
    assert fire(spark, pct=10.0)[0] == pytest.approx(0.15 * 0.5)
    assert fire(spark, zone=3.0)[0] == 0
    assert fire(spark, zone=3.1)[1]["regla_5"][1].endswith("mucho mayor que cajeros cercanos")
    assert fire(spark, zone=0.2)[0] == pytest.approx(0.07)


def test_all_rules_reach_one(spark):
    score, fired = fire(spark, amount=1e9, hour=3, dawn=0.0, zone=9.0, pct=90.0)
    assert score == pytest.approx(1.0)
    assert len(fired) == 5


def test_missing_profile_values(spark):
    assert fire(spark, std=None, mean=None, zone=None, pct=None, dawn=None, hour=12) == (0.0, {})


@pytest.mark.parametrize(
    "score, level", [(0.9, "Crítico"), (0.89, "Advertencia"), (0.7, "Advertencia"), (0.5, "Sospechoso"), (0.49, "Normal")]
)
def test_levels(spark, score, level):
    assert spark.range(1).select(rules.level(F.lit(score))).first()[0] == level


def test_training_range_reaches_every_level(spark):
    score = [rules.scaled_model(F.lit(raw), -0.8, -0.4) for raw in (-0.9, -0.8, -0.6, -0.4, -0.1)]
    assert list(spark.range(1).select(*score).first()) == pytest.approx([1.0, 1.0, 0.5, 0.0, 0.0])


def test_file_alert_detail(spark):
    known = spark.createDataFrame(
        [("100", 350.0, AT.replace(hour=3), 100.0, 10.0, 0.0, 1.0, 0.0)],
        "cod_cajero string, monto_dispensado double, fecha_hora timestamp_ntz, dispensacion_promedio double,"
        " dispensacion_std double, disp_madrugada double, ratio_vs_zona double, pct_anomalias_3std double",
    )
    row = rules.file_alerts(rules.score_totals(known, F.lit(-0.5))).first()
    detail = json.loads(row.razones)
    assert row.score_anomalia == pytest.approx(0.6 / (1 + 2.718281828459045**-0.5) + 0.4 * (0.3 + 0.25 + 0.1))
    assert (row.severidad, row.desviacion_std, row.monto_esperado) == ("Sospechoso", 25.0, 100.0)
    assert set(detail["reglas_activadas"]) == {
        "regla_1_dispensacion_extrema",
        "regla_2_horario_sospechoso",
        "regla_3_cambio_drastico",
    }
    assert row.descripcion.startswith("Cajero 100 dispensó $350 (promedio histórico: $100). Razones: Dispensación extrema")


# -- reasons -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, fast, deviation, kind, severity",
    [
        ("Transacción a las 23:00 en cajero que cierra de noche", False, 0.0, "ubicacion", 4),
        ("Transacción en madrugada (03:00)", False, 0.0, "temporal", 4),
        ("Transacción en fin de semana (Sáb)", False, 0.0, "otro", 4),
        ("Retiro máximo: $2,000,000", False, 0.0, "monto", 8),
        ("Monto 3.5σ por encima del promedio del cajero", False, 3.5, "monto", 7),
        ("Diferencia entre valor original y final: $5,000", False, 0.0, "otro", 4),
        ("Transacción 4 segundos después de la anterior", True, 0.0, "velocidad", 8),
        ("Alta frecuencia en cajero: 40 tx/hora", False, 0.0, "velocidad", 6),
        ("Cambio de PIN detectado", False, 0.0, "operacion", 5),
        ("Cambio de PIN detectado", True, 0.0, "operacion", 4),
        ("Transacción rechazada", False, 0.0, "operacion", 4),
        ("Cajero con alta tasa de rechazo: 40.0%", False, 0.0, "ubicacion", 4),
        ("Cajero aislado (no adyacente a oficina)", False, 0.0, "ubicacion", 5),
        ("Patrón anómalo detectado por ML (score: 0.900)", False, 0.0, "ml", 4),
        ("Madrugada en cajero cerrado", False, 0.0, "temporal", 9),
    ],
)
def test_reason_class(spark, text, fast, deviation, kind, severity):
    df = spark.createDataFrame([(text, fast, deviation)], "t string, f boolean, d double")
    row = df.select(
        reasons.reason_type(F.col("t")).alias("k"), reasons.reason_severity(F.col("t"), F.col("f"), F.col("d")).alias("s")
    ).first()
    assert (row.k, row.s) == (kind, severity)


def test_opening_hours(spark):
    machines = spark.createDataFrame(
        [("1", "6:00", "22:00"), ("2", "18:00", "02:00"), ("3", None, "x")],
        "codigo string, hora_apertura_atm string, hora_cierre_atm string",
    )
    times = [(m, h) for m in (1, 2, 3, 4) for h in (1, 5, 6, 12, 19, 22, 23)]
    tx = spark.createDataFrame(
        [(i, m, dt.datetime(2024, 1, 1, h, 0)) for i, (m, h) in enumerate(times)],
        "id_tlf long, cod_terminal int, fecha_transaccion timestamp_ntz",
    )
    got = {(r.cod_terminal, r.fecha_transaccion.hour) for r in outside_hours(tx, machines).collect()}
    assert got == {(1, 1), (1, 5), (1, 23), (2, 5), (2, 6), (2, 12)}
