"""Keyed state on arriving rows: recent means and live rules against their batch forms."""

import datetime as dt
import random

import numpy as np
import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from tillwatch.operators import behaviour, rules
from tillwatch.session import work_dir
from tillwatch.streaming import live_rules, recent_mean

START = dt.datetime(2024, 1, 1, 10)
TX = "id_tlf long, cod_terminal int, fecha_transaccion timestamp_ntz, tipo_operacion string, cod_estado_transaccion int, valor_transaccion double"


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def transactions(seed, low, high, n, first):
    draw = random.Random(seed)
    kinds = ["Cambio De Pin", "Retiro", "Avance", "Depositos"]
    return [
        (first + i, draw.choice([1, 1, 1, 2]), START + dt.timedelta(seconds=draw.randint(low * 60, high * 60)), draw.choice(kinds), draw.choice([1, 1, 2]), float(draw.randint(1, 900_000)))
        for i in range(n)
    ]


def hits(df):
    return sorted((r.regla, r.id_tlf, r.cod_terminal, r.fecha_transaccion, round(r.valor, 6)) for r in df.collect())


def test_live_rules_equal_the_batch_rules(spark):
    first, second, third = transactions(1, 0, 60, 150, 0), transactions(2, 55, 120, 150, 1000), transactions(3, 115, 200, 150, 2000)
    late = [(9000, 1, at(1), "Cambio De Pin", 1, 1.0), (9001, 1, at(2), "Retiro", 1, 5e6)]
    odd = [(None, 1, at(150), "Retiro", 1, 5e6), (9003, None, at(150), "Retiro", 1, 5e6), (9004, 1, None, "Retiro", 1, 5e6), (9005, 1, at(150), None, None, None)]
    folder = work_dir(spark, "in")
    targets = {n: (work_dir(spark, n), work_dir(spark, n + "-state")) for n in ("rates", "pins")}
    limits = [live_rules.RateRule("cambios_pin", "cambio", 2, 900), live_rules.RateRule("retiro_grande", "retiro", 1e6, 600), live_rules.RateRule("velocidad", "todas", 4, 300)]
    for part in (first + first[:20], second + first[140:], third + late + odd, transactions(4, 400, 401, 2, 5000)):  # a run for each: restarts
        spark.createDataFrame(part, TX).coalesce(2).write.mode("append").parquet(folder)
        arriving = spark.readStream.schema(TX).parquet(folder)
        run(live_rules.maintain_live_hits(live_rules.live_rates(arriving, "10 minutes", limits), *targets["rates"], once=True))
        run(live_rules.maintain_live_hits(live_rules.live_pin_withdrawals(arriving, "10 minutes", 300), *targets["pins"], once=True))
    batch = spark.createDataFrame(first + second + third + odd[3:], TX)
    named = {
        "cambios_pin": behaviour.frequent_pin_changes(batch, 2, 900).withColumnRenamed("cambios_pin", "valor"),
        "retiro_grande": behaviour.large_withdrawals(batch, 1e6, 600).withColumnRenamed("monto_periodo", "valor"),
        "velocidad": behaviour.high_rate(batch, 4, 300).withColumnRenamed("transacciones_periodo", "valor"),
    }
    want = sorted(h for n, df in named.items() for h in hits(df.withColumn("regla", F.lit(n))))
    assert len(want) > 100 and {h[0] for h in want} == set(named)
    assert hits(spark.read.parquet(targets["rates"][0])) == want
    pins = behaviour.withdrawal_after_pin_change(batch, 300).withColumnRenamed("segundos_desde_pin", "valor")
    assert hits(spark.read.parquet(targets["pins"][0])) == hits(pins.withColumn("regla", F.lit("pin_y_retiro"))) != []


def test_rate_hits_see_rows_of_the_same_time():
    rows = pd.DataFrame({"instante": [0, 0, 1_000_000, 9_000_000], "id": [1, 2, 3, 4], "cambio": [True, True, False, True], "retiro": [None, None, 5.0, None], "visto": False})
    found = live_rules.rate_hits(rows, [live_rules.RateRule("cambios_pin", "cambio", 1, 5)], np.ones(4, bool))
    assert found["id_tlf"].tolist() == [1, 2] and found["valor"].tolist() == [2.0, 2.0]


TOTALS = "archivo_origen string, cod_cajero string, monto_dispensado double, fecha_hora timestamp_ntz"


def means(df):
    return sorted((r.cod_cajero, r.fecha_hora, r.monto_dispensado, None if r.promedio_reciente is None else round(r.promedio_reciente, 6)) for r in df.collect())


def test_recent_means_survive_restarts(spark):
    draw = random.Random(2)
    rows = [(f"f{i:03}", str(m), float(draw.randint(1, 1000)), at(15 * i + m)) for i in range(60) for m in range(3) if draw.random() < 0.8]
    folder, target, state = (work_dir(spark, n) for n in ("totals", "recent", "recent-state"))
    for lote, part in enumerate((rows[:40], rows[40:41], rows[41:90], rows[90:])):
        spark.createDataFrame(part, TOTALS).write.parquet(f"{folder}/lote={lote}")
        run(recent_mean.maintain_recent_means(recent_mean.totals_stream(spark, folder), target, state, once=True, buckets=3, max_age=3600))
    batch = rules.with_recent_mean(spark.createDataFrame(rows, TOTALS), 3, 3600)
    assert means(spark.read.parquet(target)) == means(batch)
    assert {r[3] is None for r in means(batch)} == {True, False}


def test_late_repeated_and_forgotten_totals(spark):
    folder, target, state = (work_dir(spark, n) for n in ("totals", "recent", "recent-state"))
    parts = [
        [("a", "1", 10.0, at(0)), ("b", "1", 20.0, at(30)), ("x", None, 1.0, at(0)), ("x", "1", None, at(0)), (None, "2", 7.0, at(0))],
        [("c", "1", 40.0, at(15)), ("b", "1", 30.0, at(30))],  # one late, one again with another amount
        [("d", "1", 5.0, at(45))],
        [("z", "2", 1.0, at(45 + 60 * 10))],  # the others go on
        [("e", "1", 5.0, at(45 + 60 * 11))],  # after ten hours of silence the state is gone
        [("f", "1", 5.0, at(0))],  # later than allowed
    ]
    for lote, part in enumerate(parts):
        spark.createDataFrame(part, TOTALS).write.parquet(f"{folder}/lote={lote}")
        run(recent_mean.maintain_recent_means(recent_mean.totals_stream(spark, folder), target, state, once=True, forget=3600, lateness="2 hours"))
    got = {(r.archivo_origen, r.monto_dispensado): r.promedio_reciente for r in spark.read.parquet(target).collect()}
    assert got == {("a", 10.0): None, ("b", 20.0): 10.0, ("", 7.0): None, ("c", 40.0): 10.0, ("b", 30.0): 25.0, ("d", 5.0): 80 / 3, ("z", 1.0): 7.0, ("e", 5.0): None}


class Held:
    """The state of one machine, and the calls made on it."""

    def __init__(self):
        self.rows, self.calls = [], []

    def getListState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return iter(self.rows)

    def put(self, rows):
        self.calls.append("put")
        self.rows = rows

    def registerTimer(self, at):
        self.calls.append(("register", at))

    def deleteTimer(self, at):
        self.calls.append(("delete", at))


def test_a_machine_is_plain_rows_and_few_calls():
    held, mean = Held(), recent_mean.RecentMean(2, 100, 1)
    mean.init(held)
    total = Row("archivo_origen", "cod_cajero", "monto_dispensado", "fecha_hora", "instante")

    def handle(*rows):
        held.calls.clear()
        return [tuple(r)[2:] for r in mean.handleInputRows(("1",), iter([total(f, "1", m, None, t) for f, m, t in rows]), None)]

    nan = float("nan")
    assert handle(("b", 4.0, 2000), ("a", 2.0, 1000), ("c", nan, 3000)) == [(2.0, 1000, None), (4.0, 2000, 2.0), (None, 3000, 3.0)]
    assert held.calls == ["get", "put", ("register", 1003)]
    assert handle(("d", 6.0, 1500), ("e", 8.0, 3000)) == [(6.0, 1500, 2.0), (8.0, 3000, 5.0)]
    assert held.calls == ["get", "put"] and held.rows == [(1000, 2.0), (1500, 6.0), (2000, 4.0), (3000, 8.0)]
    late = [(str(i), 1.0, 4000 + i) for i in range(7)]
    assert handle(*late)[:2] == [(1.0, 4000, 6.0), (1.0, 4001, 4.5)]
    assert held.calls == ["get", "put", ("delete", 1003), ("register", 1004)] and len(held.rows) == 8 and held.rows[0] == (3000, 8.0)


def test_alerts_use_the_live_mean(spark):
    profile = spark.createDataFrame(
        [(m, 1000.0, 1e9, 0.0, 1.0, 0.0, -0.9) for m in ("1", "2")],
        "cod_cajero string, dispensacion_promedio double, dispensacion_std double, disp_madrugada double, ratio_vs_zona double, pct_anomalias_3std double, score_modelo double",
    )
    folder, target, state = (work_dir(spark, n) for n in ("totals", "alerts", "alerts-state"))
    for lote, part in enumerate(([("a", "1", 100.0, at(0)), ("a", "2", 5000.0, at(0))], [("b", "1", 1100.0, at(15)), ("b", "2", 5100.0, at(15))])):
        spark.createDataFrame(part, TOTALS).write.parquet(f"{folder}/lote={lote}")
        run(recent_mean.watch_recent(recent_mean.totals_stream(spark, folder), profile, target, state, min_score=0.0, once=True))
    changed = {(r.cod_cajero, r.fecha_hora) for r in spark.read.parquet(target).collect() if "Cambio drástico" in r.descripcion}
    assert changed == {("2", at(0)), ("1", at(15))}  # without earlier totals the history counts
