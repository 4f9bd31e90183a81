"""Reporting queries over alerts, machines, profiles, roll-ups and scores.

Bounds are inclusive unless said otherwise. Every limited list has its key as
the last sort column, so its content does not depend on row order.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.functions.calendar import bucket, sunday_weekday
from tillwatch.functions.text import contains_ignoring_case
from tillwatch.operators.alerts import severity_rank
from tillwatch.operators.neighbours import with_coordinates
from tillwatch.operators.rollup import as_of_or_latest
from tillwatch.plans.skew import anti_join, lookup_join
from tillwatch.schemas import DISPENSING_TYPES, STATE_OK

Bound = datetime | date | str

# The severity labels of bucket alerts and of transaction and file alerts.
BUCKET_LABELS = {"criticas": "critico", "altas": "alto", "medias": "medio"}
LEVEL_LABELS = {"criticas": "Crítico", "advertencias": "Advertencia", "sospechosas": "Sospechoso"}


def _between(ts: str, start: Bound, end: Bound) -> Column:
    return (F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) <= F.lit(end).cast("timestamp_ntz"))


def _per_label(labels: dict[str, str], column: str = "severidad", prefix: str = "") -> list[Column]:
    return [F.count_if(F.col(column) == label).alias(f"{prefix}{name}") for name, label in labels.items()]


def _place(machines: DataFrame, key: str = "codigo") -> DataFrame:
    return machines.select(
        F.col(key).cast("string").alias("cod_cajero"), "latitud", "longitud", "municipio_dane", "departamento"
    )


def _recent(alerts: DataFrame, days: int, as_of: datetime | None) -> DataFrame:
    now = as_of_or_latest(alerts, "fecha_hora", as_of)
    return alerts.filter(F.col("fecha_hora") >= now - F.expr(f"INTERVAL '{days}' DAY"))


# -- lists and filters ---------------------------------------------------------------------------------------


def alert_list(
    alerts: DataFrame, start: date, end: date, severity: str | None = None, limit: int = 1000, newest: str = "fecha_deteccion"
) -> DataFrame:
    """Alerts whose day is in the range, newest detection first, then highest score."""
    rows = alerts.filter(F.to_date("fecha_hora").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if severity is not None:
        rows = rows.filter(F.col("severidad") == severity)
    order = [F.desc(newest), F.desc("score_anomalia"), F.desc("fecha_hora"), F.asc("cod_cajero")]
    return rows.orderBy(*order).limit(limit)


def scores_in_range(
    scores: DataFrame, transactions: DataFrame, start: Bound, end: Bound, level: str | None = None
) -> DataFrame:
    """All scored transactions in [start, end)."""
    ts = F.col("fecha_transaccion")
    rows = transactions.filter((ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz")))
    if level is not None:
        scores = scores.filter(F.col("nivel_anomalia") == level)
    return scores.select("id_transaccion", "score_final", "nivel_anomalia").join(
        rows.select(
            F.col("id_tlf").alias("id_transaccion"),
            "fecha_transaccion",
            "cod_terminal",
            "tipo_operacion",
            "valor_transaccion",
            F.col("cod_terminal").cast("string").alias("cod_cajero"),
        ),
        "id_transaccion",
    )


def scored_transactions(
    scores: DataFrame,
    transactions: DataFrame,
    machines: DataFrame,
    start: Bound,
    end: Bound,
    level: str | None = None,
    limit: int = 10_000,
) -> DataFrame:
    """The list of the ``limit`` highest scored transactions in [start, end) with their place."""
    rows = scores_in_range(scores, transactions, start, end, level)
    top = rows.orderBy(F.desc("score_final"), "id_transaccion").limit(limit)
    return (
        top.join(_place(machines), "cod_cajero", "left")
        .withColumnRenamed("municipio_dane", "municipio")
        .drop("cod_cajero")
    )


def search_machine(rows: DataFrame, fragment: str, column: str = "cod_cajero") -> DataFrame:
    return rows.filter(contains_ignoring_case(column, fragment))


PROFILE_CARD = [
    "cod_cajero",
    "dispensacion_promedio",
    "dispensacion_std",
    "dispensacion_max",
    "coef_variacion",
    "pct_anomalias_3std",
    "latitud",
    "longitud",
    "municipio_dane",
    "departamento",
    "num_periodos_15min",
    "transacciones_totales",
]


def machine_card(profile: DataFrame, machine: str) -> DataFrame:
    return profile.filter(F.col("cod_cajero") == machine).select(*PROFILE_CARD)


def machine_alerts(alerts: DataFrame, machine: str, limit: int = 100) -> DataFrame:
    columns = [
        "fecha_hora",
        "severidad",
        "score_anomalia",
        "monto_dispensado",
        "monto_esperado",
        "desviacion_std",
        "descripcion",
        "razones",
        "tipo_anomalia",
    ]
    return alerts.filter(F.col("cod_cajero") == machine).select(*columns).orderBy(F.desc("fecha_hora")).limit(limit)


def transaction_reasons(reasons: DataFrame, transaction: int) -> DataFrame:
    return (
        reasons.filter(F.col("id_transaccion") == transaction)
        .orderBy(F.desc("severidad"), "orden")
        .select("tipo_razon", "descripcion", F.col("severidad").cast("int").alias("severidad"))
    )


def machine_locations(machines: DataFrame) -> DataFrame:
    return with_coordinates(machines).select(
        "codigo", "latitud", "longitud", F.col("municipio_dane").alias("municipio"), "departamento"
    )


def latest_alerts(alerts: DataFrame, limit: int = 100) -> DataFrame:
    columns = [
        "cod_cajero",
        "fecha_hora",
        "severidad",
        "score_anomalia",
        "monto_dispensado",
        "monto_esperado",
        "descripcion",
        "razones",
    ]
    return (
        alerts.select(*columns).orderBy(F.desc("fecha_hora"), F.desc("score_anomalia"), "cod_cajero").limit(limit)
    )


def located_alerts(alerts: DataFrame, profile: DataFrame, start: Bound, end: Bound) -> DataFrame:
    """Critical and high alerts in the range whose machine has coordinates, with the place."""
    places = _place(profile, "cod_cajero").filter("latitud IS NOT NULL AND longitud IS NOT NULL")
    rows = alerts.filter(_between("fecha_hora", start, end) & F.col("severidad").isin("critico", "alto"))
    rows = rows.select("cod_cajero", "fecha_hora", "severidad", "score_anomalia", "monto_dispensado", "descripcion")
    return lookup_join(rows, places, ["cod_cajero"], "inner")


def top_located_alerts(alerts: DataFrame, profile: DataFrame, start: Bound, end: Bound, limit: int = 100) -> DataFrame:
    return (
        located_alerts(alerts, profile, start, end)
        .orderBy(F.desc("score_anomalia"), "cod_cajero", "fecha_hora")
        .limit(limit)
    )


def top_by_z(features: DataFrame, limit: int = 5, absolute: bool = False) -> DataFrame:
    z = F.abs("z_score_vs_cajero") if absolute else F.col("z_score_vs_cajero")
    rows = features.filter("z_score_vs_hora IS NOT NULL") if absolute else features
    return rows.orderBy(z.desc_nulls_last(), "cod_terminal", "bucket_15min").limit(limit)


def top_machines_by_count(summary: DataFrame, limit: int = 10) -> DataFrame:
    return (
        summary.select(
            "cod_terminal",
            "total_transacciones",
            F.col("monto_total_dispensado").alias("monto_total"),
            F.col("dispensacion_promedio").alias("promedio"),
            F.col("dispensacion_max").alias("maximo"),
            "fecha_primera_transaccion",
            "fecha_ultima_transaccion",
        )
        .orderBy(F.desc("total_transacciones"), "cod_terminal")
        .limit(limit)
    )


def latest_buckets(rollup: DataFrame, limit: int = 20, as_of: datetime | None = None) -> DataFrame:
    """Roll-up rows of the last 24 hours, newest first, then busiest."""
    now = as_of_or_latest(rollup, "bucket_15min", as_of)
    return (
        rollup.filter(F.col("bucket_15min") >= now - F.expr("INTERVAL '24' HOUR"))
        .select(
            "cod_terminal",
            "bucket_15min",
            "tipo_operacion",
            "num_transacciones",
            F.col("monto_total_dispensado").alias("monto_total"),
            "monto_promedio",
        )
        .orderBy(F.desc("bucket_15min"), F.desc("num_transacciones"), "cod_terminal", "tipo_operacion")
        .limit(limit)
    )


def last_run_alerts(
    alerts: DataFrame, machines: DataFrame, minutes: int = 5, as_of: datetime | None = None, detected: str = "fecha_deteccion"
) -> DataFrame:
    """Alerts detected in the last minutes, highest score first, with the place where known."""
    now = as_of_or_latest(alerts, detected, as_of)
    rows = alerts.filter(F.col(detected) >= now - F.expr(f"INTERVAL '{minutes}' MINUTE"))
    places = _place(machines).drop("departamento")
    rows = rows.select("cod_cajero", "fecha_hora", "severidad", "score_anomalia", "monto_dispensado", "descripcion")
    return lookup_join(rows, places, ["cod_cajero"]).orderBy(F.desc("score_anomalia"), "cod_cajero", "fecha_hora")


# -- key figures ---------------------------------------------------------------------------------------------


def alert_kpis(alerts: DataFrame, start: Bound, end: Bound) -> DataFrame:
    return alerts.filter(_between("fecha_hora", start, end)).agg(
        *_per_label(BUCKET_LABELS, prefix="alertas_"),
        F.count(F.lit(1)).alias("total_alertas"),
        F.countDistinct("cod_cajero").alias("cajeros_con_alertas"),
    )


def alert_shares(alerts: DataFrame) -> DataFrame:
    """All-time count per severity, total, and each severity's share of the total in percent."""
    counts = alerts.agg(*_per_label(BUCKET_LABELS), F.count(F.lit(1)).alias("total"))
    return counts.withColumns({f"pct_{n}": F.try_divide(F.col(n) * 100, F.col("total")) for n in BUCKET_LABELS})


def level_kpis(alerts: DataFrame, detected: str = "fecha_deteccion") -> DataFrame:
    return alerts.agg(
        F.count(F.lit(1)).alias("total_alertas"),
        *_per_label(LEVEL_LABELS),
        F.countDistinct("cod_cajero").alias("cajeros_afectados"),
        F.max(detected).alias("ultima_actualizacion"),
    )


def score_kpis(scores: DataFrame, transactions: DataFrame) -> DataFrame:
    known = scores.join(transactions.select(F.col("id_tlf").alias("id_transaccion")), "id_transaccion")
    return known.agg(
        F.count(F.lit(1)).alias("total_anomalias"),
        *_per_label(LEVEL_LABELS, "nivel_anomalia"),
        F.countDistinct("id_transaccion").alias("transacciones_unicas"),
    )


def alerts_per_day(alerts: DataFrame, start: Bound, end: Bound) -> DataFrame:
    return (
        alerts.filter(_between("fecha_hora", start, end))
        .groupBy(F.to_date("fecha_hora").alias("fecha"))
        .agg(*_per_label({k: BUCKET_LABELS[k] for k in ("criticas", "altas")}))
    )


def alerts_per_day_and_severity(alerts: DataFrame, ts: str = "fecha_hora", label: str = "severidad") -> DataFrame:
    return alerts.groupBy(F.to_date(ts).alias("fecha"), label).agg(F.count(F.lit(1)).alias("cantidad"))


def critical_bands(daily: DataFrame, days: int = 7, width: float = 2.0) -> DataFrame:
    """Centred mean of daily critical alerts with a band; null where the frame is not full.

    One row per day: the unpartitioned window sees only daily counts.
    """
    half = days // 2
    frame = Window.orderBy("fecha").rowsBetween(-half, half)
    full = F.count(F.lit(1)).over(frame) == days
    mean, std = F.avg("criticas").over(frame), F.stddev_samp("criticas").over(frame)
    rows = daily.select(
        "fecha",
        "criticas",
        F.when(full, mean).alias("criticas_promedio"),
        F.when(full, std).alias("criticas_std"),
    )
    upper = F.col("criticas_promedio") + width * F.col("criticas_std")
    lower = F.col("criticas_promedio") - width * F.col("criticas_std")
    banded = rows.withColumn("banda_superior", upper).withColumn(
        "banda_inferior", F.when(lower.isNotNull(), F.greatest(lower, F.lit(0.0)))
    )
    outside = (F.col("criticas") > F.col("banda_superior")) | (F.col("criticas") < F.col("banda_inferior"))
    return banded.withColumn("es_anomalia", F.coalesce(outside, F.lit(False)))


# -- machines with most alerts -------------------------------------------------------------------------------


def top_machines(
    alerts: DataFrame,
    places: DataFrame,
    limit: int = 10,
    start: Bound | None = None,
    end: Bound | None = None,
    critical: str = "critico",
) -> DataFrame:
    """Machines by number of alerts, with place, mean score, last alert and worst severity by rank."""
    rows = alerts if start is None else alerts.filter(_between("fecha_hora", start, end))
    top = (
        rows.groupBy("cod_cajero")
        .agg(
            F.count(F.lit(1)).alias("num_alertas"),
            F.count_if(F.col("severidad") == critical).alias("alertas_criticas"),
            F.max("fecha_hora").alias("ultima_alerta"),
            F.avg("score_anomalia").alias("score_promedio"),
            F.max_by("severidad", severity_rank()).alias("severidad_max"),
        )
        .orderBy(F.desc("num_alertas"), F.desc("alertas_criticas"), "cod_cajero")
        .limit(limit)
    )
    return top.join(
        places.select("cod_cajero", "municipio_dane", "departamento"), "cod_cajero", "left"
    )


def top_machines_by_scores(scored: DataFrame, machines: DataFrame, limit: int = 10) -> DataFrame:
    """Scored transactions per machine with a known municipality: count and mean score.

    ``scored`` are all of a range (``scores_in_range``), not a list cut to the highest.
    """
    per_machine = scored.groupBy("cod_terminal", "cod_cajero").agg(
        F.count("id_transaccion").alias("anomalias"), F.avg("score_final").alias("score_promedio")
    )
    return (
        per_machine.join(_place(machines), "cod_cajero")
        .withColumnRenamed("municipio_dane", "municipio")
        .filter("municipio IS NOT NULL")
        .select("cod_terminal", "municipio", "anomalias", "score_promedio")
        .orderBy(F.desc("anomalias"), "cod_terminal", "municipio")
        .limit(limit)
    )


def volatile_machines(profile: DataFrame, machines: DataFrame, limit: int = 20) -> DataFrame:
    top = (
        profile.filter("coef_variacion IS NOT NULL")
        .select("cod_cajero", "dispensacion_promedio", "dispensacion_std", "coef_variacion", "pct_anomalias_3std")
        .orderBy(F.desc("coef_variacion"), "cod_cajero")
        .limit(limit)
    )
    places = _place(machines).select("cod_cajero", F.col("municipio_dane").alias("municipio"), "departamento")
    return top.join(places, "cod_cajero", "left")


# -- patterns in time and score ------------------------------------------------------------------------------


def hour_weekday_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(
        F.hour("fecha_hora").alias("hora"), sunday_weekday("fecha_hora").alias("dia_semana")
    ).agg(F.count(F.lit(1)).alias("num_alertas"), F.avg("score_anomalia").alias("score_promedio"))


def hour_weekday_matrix(alerts: DataFrame) -> DataFrame:
    """One row per hour, one column per weekday (``d0`` = Sunday), 0 where there are none."""
    day = sunday_weekday("fecha_hora")
    return alerts.groupBy(F.hour("fecha_hora").alias("hora")).agg(
        *[F.count_if(day == d).alias(f"d{d}") for d in range(7)]
    )


def monthly_trend(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.date_trunc("month", "fecha_hora").cast("timestamp_ntz").alias("mes")).agg(
        F.count(F.lit(1)).alias("num_alertas"), *_per_label({k: BUCKET_LABELS[k] for k in ("criticas", "altas")})
    )


def score_bands(alerts: DataFrame) -> DataFrame:
    score = F.col("score_anomalia")
    band = (
        F.when(score >= 90, "90-100")
        .when(score >= 80, "80-89")
        .when(score >= 70, "70-79")
        .when(score >= 60, "60-69")
        .otherwise("50-59")
    )
    return alerts.groupBy(band.alias("rango_score")).agg(F.count(F.lit(1)).alias("cantidad"))


def score_histogram(alerts: DataFrame, bins: int = 50) -> DataFrame:
    """Counts per equal-width bin (1..bins between lowest and highest score) and severity."""
    bounds = alerts.agg(F.struct(F.min("score_anomalia").alias("lo"), F.max("score_anomalia").alias("hi")))
    rows = alerts.withColumn("_b", bounds.scalar())
    share = F.try_divide(F.col("score_anomalia") - F.col("_b.lo"), F.col("_b.hi") - F.col("_b.lo"))
    bin_number = F.coalesce(F.least(F.floor(share * bins) + 1, F.lit(bins)), F.lit(1)).cast("int")
    return rows.groupBy(bin_number.alias("intervalo"), "severidad").agg(F.count(F.lit(1)).alias("cantidad"))


def compare_periods(
    alerts: DataFrame, start: Bound, end: Bound, before: Bound, severity: str = "critico"
) -> DataFrame:
    """Counts and mean score of [start, end] against [before, start), in one pass."""
    ts = F.col("fecha_hora")
    start_c, end_c, before_c = (F.lit(b).cast("timestamp_ntz") for b in (start, end, before))
    now, then = (ts >= start_c) & (ts <= end_c), (ts >= before_c) & (ts < start_c)
    score = F.col("score_anomalia")
    sums = alerts.filter((F.col("severidad") == severity) & (now | then)).agg(
        F.count_if(now).alias("alertas_actuales"),
        F.avg(F.when(now, score)).alias("score_actual"),
        F.count_if(then).alias("alertas_anteriores"),
        F.avg(F.when(then, score)).alias("score_anterior"),
    )
    change = F.try_divide(
        (F.col("alertas_actuales") - F.col("alertas_anteriores")) * F.lit(100.0), F.col("alertas_anteriores")
    )
    return sums.withColumn("cambio_porcentual", F.round(change, 2)).withColumn(
        "cambio_score", F.col("score_actual") - F.col("score_anterior")
    )


def severity_summary(alerts: DataFrame) -> DataFrame:
    return (
        alerts.groupBy("severidad")
        .agg(
            F.count(F.lit(1)).alias("cantidad"),
            F.avg("score_anomalia").alias("score_promedio"),
            F.avg("desviacion_std").alias("desv_std_promedio"),
        )
        .withColumn("rango", severity_rank())
        .orderBy(F.desc("rango"), "severidad")
        .drop("rango")
    )


def severity_share(alerts: DataFrame, label: str = "severidad") -> DataFrame:
    return alerts.groupBy(label).agg(F.count(F.lit(1)).alias("cantidad"))


# -- places --------------------------------------------------------------------------------------------------


def alerts_by_department(alerts: DataFrame, places: DataFrame, days: int = 30, as_of: datetime | None = None) -> DataFrame:
    return _by_place(_recent(alerts, days, as_of), places, ["departamento"], with_score=True)


def alerts_by_municipality(
    alerts: DataFrame, places: DataFrame, days: int = 30, limit: int = 20, as_of: datetime | None = None
) -> DataFrame:
    rows = _by_place(_recent(alerts, days, as_of), places, ["municipio_dane", "departamento"])
    return rows.orderBy(F.desc("num_alertas"), "municipio_dane", "departamento").limit(limit)


def _by_place(alerts: DataFrame, places: DataFrame, columns: Sequence[str], with_score: bool = False) -> DataFrame:
    """Alerts are summed per machine before the join, so each machine is one row of it."""
    score = F.col("score_anomalia")
    per_machine = alerts.groupBy("cod_cajero").agg(
        F.count(F.lit(1)).alias("n"), F.sum(score).alias("suma"), F.count(score).alias("con_score")
    )
    place = places.select("cod_cajero", *columns).filter(F.col(columns[0]).isNotNull())
    aggregates = [F.sum("n").alias("num_alertas"), F.count(F.lit(1)).alias("cajeros_afectados")]
    if with_score:
        aggregates.append(F.try_divide(F.sum("suma"), F.sum("con_score")).alias("score_promedio"))
    return per_machine.join(place, "cod_cajero").groupBy(*columns).agg(*aggregates)


# Risk weight per severity level, in tenths; any other label weighs 2 tenths.
RISK_TENTHS = {"Crítico": 50, "Advertencia": 10, "critico": 50, "alto": 10}
OTHER_RISK_TENTHS = 2
HIGH_RISK = 20


def risk_map(alerts: DataFrame, machines: DataFrame, days: int = 180, as_of: datetime | None = None) -> DataFrame:
    """Per located machine: events, weighted risk and last event. Weights are summed as whole tenths."""
    weights = F.create_map(*[F.lit(v) for pair in RISK_TENTHS.items() for v in pair])
    weight = F.coalesce(F.try_element_at(weights, F.col("severidad")), F.lit(OTHER_RISK_TENTHS))
    per_machine = _recent(alerts, days, as_of).groupBy("cod_cajero").agg(
        F.count(F.lit(1)).alias("total_eventos"),
        (F.sum(weight) / 10).alias("risk_score"),
        F.max("fecha_hora").alias("ultima_anomalia"),
    )
    return per_machine.join(_place(machines).filter("latitud IS NOT NULL"), "cod_cajero")


def risk_summary(risk: DataFrame) -> DataFrame:
    """Machines at risk, those above the high-risk line, and the 95th percentile that caps the colours.

    The percentile is taken over counts per distinct risk value.
    """
    values = risk.groupBy("risk_score").agg(F.count(F.lit(1)).alias("n"))
    return values.agg(
        F.sum("n").alias("cajeros"),
        F.coalesce(F.sum(F.when(F.col("risk_score") > HIGH_RISK, F.col("n"))), F.lit(0)).alias("alto_riesgo"),
        F.percentile("risk_score", 0.95, F.col("n")).alias("tope_color"),
    )


def map_centre(located: DataFrame) -> DataFrame:
    return located.agg(F.avg("latitud").alias("latitud"), F.avg("longitud").alias("longitud"))


# -- history of the roll-up ----------------------------------------------------------------------------------


def history_per_machine(rollup: DataFrame) -> DataFrame:
    x = "monto_total_dispensado"
    return rollup.groupBy("cod_terminal").agg(
        F.count(F.lit(1)).alias("num_periodos"),
        F.avg(x).alias("dispensacion_promedio"),
        F.stddev_samp(x).alias("dispensacion_std"),
        F.max(x).alias("dispensacion_max"),
        F.min("bucket_15min").alias("fecha_inicio"),
        F.max("bucket_15min").alias("fecha_fin"),
    )


def history_overview(history: DataFrame) -> DataFrame:
    """Machines, mean of their means, periods and whole days covered."""
    span = F.max("fecha_fin") - F.min("fecha_inicio")
    return history.agg(
        F.count(F.lit(1)).alias("cajeros"),
        F.avg("dispensacion_promedio").alias("promedio_global"),
        F.sum("num_periodos").alias("periodos"),
        F.extract(F.lit("DAY"), span).cast("int").alias("dias_historia"),
    )


def hourly_profile(rollup: DataFrame) -> DataFrame:
    x = "monto_total_dispensado"
    return (
        rollup.groupBy(F.hour("bucket_15min").alias("hora"))
        .agg(
            F.avg(x).alias("dispensacion_promedio"),
            F.count(F.lit(1)).alias("num_transacciones"),
            F.stddev_samp(x).alias("dispensacion_std"),
        )
        .withColumn("banda_superior", F.col("dispensacion_promedio") + F.col("dispensacion_std"))
        .withColumn("banda_inferior", F.col("dispensacion_promedio") - F.col("dispensacion_std"))
    )


# -- data checks ---------------------------------------------------------------------------------------------


def summary_quality(summary: DataFrame, active: int = 100) -> DataFrame:
    parts = [f"disp_promedio_{p}" for p in ("madrugada", "manana", "tarde", "noche")]
    any_part = F.coalesce(*[F.col(p) for p in parts]).isNotNull()
    return summary.agg(
        F.count(F.lit(1)).alias("total_cajeros"),
        F.count("dispensacion_promedio").alias("con_promedio"),
        F.count("dispensacion_std").alias("con_std"),
        F.count_if(F.col("total_transacciones") > 0).alias("con_transacciones"),
        F.count_if(any_part).alias("con_patron_horario"),
        F.count_if(F.col("total_transacciones") > active).alias("cajeros_activos"),
        F.avg("dispensacion_promedio").alias("promedio_general"),
        F.max("dispensacion_max").alias("max_dispensacion"),
    )


# Labels of the parts of the day in the quality report.
PART_LABELS = {
    "disp_promedio_madrugada": "Madrugada (0-6h)",
    "disp_promedio_manana": "Mañana (6-12h)",
    "disp_promedio_tarde": "Tarde (12-18h)",
    "disp_promedio_noche": "Noche (18-24h)",
}


def part_of_day_profile(summary: DataFrame) -> DataFrame:
    """Machines and mean amount per part of the day, from one pass over the summary."""
    labelled = summary.select(*[F.col(c).alias(label) for c, label in PART_LABELS.items()])
    long = labelled.unpivot([], [f"`{label}`" for label in PART_LABELS.values()], "franja", "monto")
    return (
        long.filter("monto IS NOT NULL")
        .groupBy("franja")
        .agg(F.count(F.lit(1)).alias("cajeros"), F.avg("monto").alias("monto_promedio"))
    )


def load_check(transactions: DataFrame) -> DataFrame:
    """Rows, dispensing rows and their share, first and last time, machines, amount dispensed."""
    kind = F.col("tipo_operacion").isin(DISPENSING_TYPES)
    ok = kind & (F.col("cod_estado_transaccion") == STATE_OK)
    n = F.count(F.lit(1))
    return transactions.agg(
        n.alias("registros"),
        F.count_if(kind).alias("retiros_avances"),
        F.try_divide(F.count_if(kind) * F.lit(100.0), n).alias("pct_retiros_avances"),
        F.min("fecha_transaccion").alias("desde"),
        F.max("fecha_transaccion").alias("hasta"),
        F.countDistinct(F.when(kind, F.col("cod_terminal"))).alias("cajeros"),
        F.sum(F.when(ok, F.col("valor_transaccion"))).alias("total_dispensado"),
    )


def load_check_per_month(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("mes_origen").agg(F.count(F.lit(1)).alias("registros"))


def machines_without_summary(transactions: DataFrame, summary: DataFrame, limit: int = 10) -> DataFrame:
    """Machines that dispense but have no summary. Transactions are summed per machine before the anti-join."""
    per_machine = (
        transactions.filter(
            F.col("tipo_operacion").isin(DISPENSING_TYPES) & (F.col("cod_estado_transaccion") == STATE_OK)
        )
        .groupBy("cod_terminal")
        .agg(
            F.count(F.lit(1)).alias("num_transacciones"),
            F.min("fecha_transaccion").alias("primera_tx"),
            F.max("fecha_transaccion").alias("ultima_tx"),
        )
        .withColumn("cod_cajero", F.col("cod_terminal").cast("string"))
    )
    return anti_join(per_machine, summary, ["cod_cajero"]).drop("cod_cajero").orderBy("cod_terminal").limit(limit)


def reasons_per_type(reasons: DataFrame) -> DataFrame:
    return reasons.groupBy("tipo_razon").agg(F.count(F.lit(1)).alias("cantidad"))


def shared_patterns(
    alerts: DataFrame, places: DataFrame, min_machines: int = 2, width: str = "15 minutes"
) -> DataFrame:
    """Buckets in which several machines of one municipality raised an alert."""
    rows = lookup_join(alerts, places.select("cod_cajero", "municipio_dane"), ["cod_cajero"], "inner")
    return (
        rows.filter("municipio_dane IS NOT NULL")
        .groupBy("municipio_dane", bucket("fecha_hora", width).alias("bucket"))
        .agg(
            F.countDistinct("cod_cajero").alias("cajeros"),
            F.count(F.lit(1)).alias("alertas"),
            F.avg("score_anomalia").alias("score_promedio"),
        )
        .filter(F.col("cajeros") >= min_machines)
    )
