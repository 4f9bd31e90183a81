"""Alerts on buckets: severity, expected amount, reasons, description and the alert row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.functions.numbers import finite
from tillwatch.functions.text import fixed, grouped, signed, two_digits
from tillwatch.schemas import ALERT_COLUMNS

# Severity labels with their rank; the two vocabularies that occur in alert tables.
SEVERITY_RANK = {"critico": 3, "alto": 2, "medio": 1, "Crítico": 3, "Advertencia": 2, "Sospechoso": 1}
WEEKDAY_NAMES = ["Lunes", "Martes", "Miercoles", "Jueves", "Viernes", "Sabado", "Domingo"]


def severity_rank(label: str | Column = "severidad") -> Column:
    label = F.col(label) if isinstance(label, str) else label
    ranks = F.create_map(*[F.lit(v) for pair in SEVERITY_RANK.items() for v in pair])
    return F.coalesce(F.try_element_at(ranks, label), F.lit(0))


def severity(score: Column, z: Column) -> Column:
    """``critico`` / ``alto`` / ``medio`` from the 0-100 score and the machine z-score."""
    size = F.abs(z)
    critical = ((score >= 80) & (size >= 4)) | (score >= 85) | (size >= 5)
    return F.when(critical, "critico").when((score >= 70) | (size >= 3), "alto").otherwise("medio")


def expected_amount(amount: Column, z: Column) -> Column:
    """Amount divided by 1 + z, null at z = -1. An approximation: it is not the machine's mean."""
    return F.when(z != 0, F.try_divide(amount, 1 + z)).otherwise(amount)


def reason_text(score: Column) -> Column:
    """The thresholds a bucket crosses, joined by `` | ``."""
    z, hour, day = F.col("z_score_vs_cajero"), F.col("z_score_vs_hora"), F.col("z_score_vs_dia_semana")
    percentile, change = F.col("percentil_vs_mes"), F.col("cambio_vs_anterior")
    parts = [
        F.when(F.abs(z) >= 3, F.concat(F.lit("Z-score vs cajero: "), fixed(z, 2), F.lit(" std"))),
        F.when(F.abs(hour) >= 3, F.concat(F.lit("Z-score vs misma hora: "), fixed(hour, 2), F.lit(" std"))),
        F.when(F.abs(day) >= 2.5, F.concat(F.lit("Z-score vs mismo dia: "), fixed(day, 2), F.lit(" std"))),
        F.when(percentile >= 95, F.concat(F.lit("Percentil mensual: "), fixed(percentile, 1), F.lit("%"))),
        F.when(F.abs(change) >= 200, F.concat(F.lit("Cambio vs anterior: "), signed(change, 1), F.lit("%"))),
        F.when(score >= 70, F.concat(F.lit("Isolation Forest: "), fixed(score, 0), F.lit("/100"))),
    ]
    joined = F.concat_ws(" | ", *parts)
    return F.when(joined != "", joined).otherwise("Anomalia detectada por modelo")


def description_text(expected: Column) -> Column:
    """Amount, deviation from the expected amount, weekday, hour, score and calendar tags."""
    amount = F.col("monto_total_dispensado")
    percent = F.when(expected > 0, F.try_divide(amount - expected, expected) * 100).otherwise(F.lit(0.0))
    names = F.array(*[F.lit(n) for n in WEEKDAY_NAMES])
    day = F.coalesce(
        F.when(F.col("dia_semana").between(1, 7), F.get(names, F.col("dia_semana") - 1)), F.lit("Dia desconocido")
    )
    return F.concat_ws(
        " | ",
        F.concat(
            F.lit("Dispensacion: $"), grouped(amount), F.lit(" ("), signed(percent, 1), F.lit("% vs esperado)")
        ),
        F.concat(day, F.lit(" "), two_digits(F.col("hora_del_dia")), F.lit(":XX")),
        F.concat(F.lit("Z-score: "), fixed(F.col("z_score_vs_cajero"), 2), F.lit(" std")),
        F.when(F.col("es_fin_de_semana"), F.lit("Fin de semana")),
        F.when(F.col("es_quincena"), F.lit("Quincena")),
    )


def invert_min_max(score: Column, lowest: Column, highest: Column) -> Column:
    """Scale so that the lowest (most anomalous) score becomes 100 and the highest 0."""
    return (1 - F.try_divide(score - lowest, highest - lowest)) * 100


def build_alerts(flagged: DataFrame, kind: str = "isolation_forest", model: str = "isolation_forest_v2") -> DataFrame:
    """Alert rows of flagged buckets that carry ``score_anomalia`` (0-100) and the bucket features."""
    z = F.col("z_score_vs_cajero")
    score = F.col("score_anomalia")
    rows = flagged.withColumn(
        "_esperado", F.coalesce(finite(expected_amount(F.col("monto_total_dispensado"), z)), F.lit(None))
    )
    return rows.select(
        F.col("cod_terminal").cast("string").alias("cod_cajero"),
        F.col("bucket_15min").alias("fecha_hora"),
        F.lit(kind).alias("tipo_anomalia"),
        severity(score, z).alias("severidad"),
        score,
        F.col("monto_total_dispensado").alias("monto_dispensado"),
        F.col("_esperado").alias("monto_esperado"),
        F.abs(z).alias("desviacion_std"),
        description_text(F.col("_esperado")).alias("descripcion"),
        reason_text(score).alias("razones"),
        F.lit(model).alias("modelo_usado"),
        F.current_timestamp().alias("fecha_deteccion"),
    ).select(*ALERT_COLUMNS)
