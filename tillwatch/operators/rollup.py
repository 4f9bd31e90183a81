"""Time-bucket roll-ups and per-machine summaries of dispensing data."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwatch.functions.calendar import bucket, sunday_weekday
from tillwatch.schemas import DISPENSING_CODES, DISPENSING_TYPES, NOTE_COLUMNS, STATE_OK


def latest(df: DataFrame, ts: str) -> Column:
    """The newest time in ``df`` as a scalar subquery (no job is run while the plan is built)."""
    return df.select(F.max(ts)).scalar()


def as_of_or_latest(df: DataFrame, ts: str, as_of: datetime | None) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") if as_of is not None else latest(df, ts)


def dispensing(transactions: DataFrame) -> DataFrame:
    """Successful withdrawals and advances, with their 15-minute bucket."""
    return transactions.filter(
        F.col("tipo_operacion").isin(DISPENSING_TYPES) & (F.col("cod_estado_transaccion") == STATE_OK)
    ).select(
        "id_tlf",
        "fecha_transaccion",
        bucket("fecha_transaccion").alias("fecha_transaccion_15min"),
        "cod_terminal",
        "tipo_operacion",
        "valor_transaccion",
        "valor_transaccion_original",
        "cod_estado_transaccion",
        "adquiriente",
        "autorizador",
        "cantidad_tx",
        "fecha_negocio",
        "mes_origen",
    )


def note_rollup_aggregates() -> list[Column]:
    notes = [F.sum(c).alias(f"total_{c}") for c in NOTE_COLUMNS]
    total = F.sum(sum((F.col(c) for c in NOTE_COLUMNS[1:]), F.col(NOTE_COLUMNS[0]))).alias("total_billetes")
    return [
        F.count(F.lit(1)).alias("num_registros"),
        F.sum("monto_total").alias("monto_total"),
        F.avg("monto_total").alias("monto_promedio"),
        F.max("monto_total").alias("monto_maximo"),
        F.min("monto_total").alias("monto_minimo"),
        F.stddev_samp("monto_total").alias("monto_std"),
        *notes,
        total,
    ]


def rollup_notes(dispensed: DataFrame, width: str = "15 minutes", out: str = "bucket_15min") -> DataFrame:
    """Bucket x machine x code roll-up with note counts; ``width`` gives the 15/30/60-minute variants."""
    return (
        dispensed.groupBy(bucket("fecha_hora", width).alias(out), "cod_cajero", "cod_admin_efectivo")
        .agg(*note_rollup_aggregates())
    )


def rollup_transactions(transactions: DataFrame) -> DataFrame:
    """15-minute roll-up per machine and operation type of the successful dispensing.

    A bucket never spans two hours or two days, so its mean hour and its most
    common weekday are those of its start and need no aggregate.
    """
    return (
        dispensing(transactions)
        .withColumnRenamed("fecha_transaccion_15min", "bucket_15min")
        .groupBy("cod_terminal", "bucket_15min", "tipo_operacion")
        .agg(
            F.count(F.lit(1)).alias("num_transacciones"),
            F.sum("valor_transaccion").alias("monto_total_dispensado"),
            F.avg("valor_transaccion").alias("monto_promedio"),
            F.max("valor_transaccion").alias("monto_maximo"),
            F.min("valor_transaccion").alias("monto_minimo"),
            F.stddev_samp("valor_transaccion").alias("monto_std"),
            F.count_distinct("fecha_negocio").alias("dias_unicos"),
            F.max("fecha_transaccion").alias("ultima_transaccion"),
        )
        .withColumn("hora_promedio", F.hour("bucket_15min").cast("double"))
        .withColumn("dia_semana_mas_comun", sunday_weekday("bucket_15min"))
    )


BASELINE = ["dispensacion_promedio", "dispensacion_std"]


def bucket_totals(rollup: DataFrame, with_baseline: bool = False) -> DataFrame:
    """Bucket x machine totals over the operation types.

    ``with_baseline`` adds the machine's mean and deviation over its roll-up
    rows in the same pass: the rows are shuffled once, by machine, which also
    serves the totals and the windows of the bucket features.
    """
    totals = [
        F.sum("monto_total_dispensado").alias("monto_total_dispensado"),
        F.sum("num_transacciones").alias("num_transacciones"),
    ]
    if not with_baseline:
        return rollup.groupBy("bucket_15min", "cod_terminal").agg(*totals)
    machine = Window.partitionBy("cod_terminal")
    x = "monto_total_dispensado"
    rows = rollup.withColumn("_media", F.avg(x).over(machine)).withColumn("_des", F.stddev_samp(x).over(machine))
    return rows.groupBy("bucket_15min", "cod_terminal").agg(
        *totals, F.first("_media").alias(BASELINE[0]), F.first("_des").alias(BASELINE[1])
    )


# Monday first, by SQL day number (0 = Sunday).
WEEKDAY_COLUMNS = {
    "lunes": 1,
    "martes": 2,
    "miercoles": 3,
    "jueves": 4,
    "viernes": 5,
    "sabado": 6,
    "domingo": 0,
}


def machine_summary(transactions: DataFrame) -> DataFrame:
    """Per machine: totals, spread, mean per part of day and weekday, type shares, first and last time."""
    amount = F.col("valor_transaccion")
    hour = F.hour("fecha_transaccion")
    parts = {"madrugada": (0, 5), "manana": (6, 11), "tarde": (12, 17), "noche": (18, 23)}
    return (
        dispensing(transactions)
        .groupBy("cod_terminal")
        .agg(
            F.count(F.lit(1)).alias("total_transacciones"),
            F.sum(amount).alias("monto_total_dispensado"),
            F.avg(amount).alias("dispensacion_promedio"),
            F.stddev_samp(amount).alias("dispensacion_std"),
            F.max(amount).alias("dispensacion_max"),
            F.min(amount).alias("dispensacion_min"),
            *[
                F.avg(F.when(hour.between(lo, hi), amount)).alias(f"disp_promedio_{name}")
                for name, (lo, hi) in parts.items()
            ],
            *[
                F.avg(F.when(sunday_weekday("fecha_transaccion") == day, amount)).alias(f"disp_promedio_{name}")
                for name, day in WEEKDAY_COLUMNS.items()
            ],
            *[
                (F.count_if(F.col("tipo_operacion") == kind) / F.count(F.lit(1))).alias(name)
                for name, kind in (("ratio_retiros", "Retiro"), ("ratio_avances", "Avance"))
            ],
            F.min("fecha_transaccion").alias("fecha_primera_transaccion"),
            F.max("fecha_transaccion").alias("fecha_ultima_transaccion"),
        )
    )


def _relevant(dispensed: DataFrame) -> DataFrame:
    return dispensed.filter(F.col("cod_admin_efectivo").isin(DISPENSING_CODES))


def machine_pattern(dispensed: DataFrame, machine: str, hour: int | None = None) -> DataFrame:
    """Historic amount pattern of one machine, optionally of one hour of the day."""
    rows = _relevant(dispensed).filter(F.col("cod_cajero") == F.lit(machine))
    if hour is not None:
        rows = rows.filter(F.hour("fecha_hora") == hour)
    return rows.agg(*_pattern_aggregates())


def machine_patterns(dispensed: DataFrame, by_hour: bool = False) -> DataFrame:
    """The same pattern of every machine at once."""
    keys = ["cod_cajero"]
    rows = _relevant(dispensed)
    if by_hour:
        rows, keys = rows.withColumn("hora", F.hour("fecha_hora")), ["cod_cajero", "hora"]
    return rows.groupBy(*keys).agg(*_pattern_aggregates())


def _pattern_aggregates() -> list[Column]:
    return [
        F.avg("monto_total").alias("dispensacion_promedio"),
        F.stddev_samp("monto_total").alias("dispensacion_std"),
        F.max("monto_total").alias("dispensacion_max"),
        F.count(F.lit(1)).alias("num_transacciones"),
    ]


def register_pattern_function(spark: SparkSession, dispensed: DataFrame, name: str = "get_patron_cajero") -> None:
    """Expose :func:`machine_pattern` to SQL as a table function ``name(machine, hour)``."""
    dispensed.createOrReplaceTempView("dispensacion_efectivo")
    codes = ", ".join(str(c) for c in DISPENSING_CODES)
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(p_cod_cajero STRING, p_hora INT DEFAULT NULL)
        RETURNS TABLE (dispensacion_promedio DOUBLE, dispensacion_std DOUBLE,
                       dispensacion_max DOUBLE, num_transacciones BIGINT)
        RETURN SELECT avg(monto_total), stddev_samp(monto_total), max(monto_total), count(*)
               FROM dispensacion_efectivo
               WHERE cod_cajero = p_cod_cajero AND cod_admin_efectivo IN ({codes})
                 AND (p_hora IS NULL OR hour(fecha_hora) = p_hora)
        """
    )


def last_day_summary(dispensed: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Per machine over the 24 hours before ``as_of`` (default: the newest record)."""
    now = as_of_or_latest(dispensed, "fecha_hora", as_of)
    return (
        _relevant(dispensed)
        .filter(F.col("fecha_hora") >= now - F.expr("INTERVAL '24' HOUR"))
        .groupBy("cod_cajero")
        .agg(
            F.count(F.lit(1)).alias("num_dispensaciones"),
            F.sum("monto_total").alias("monto_total_24h"),
            F.avg("monto_total").alias("monto_promedio_24h"),
            F.max("monto_total").alias("monto_maximo_24h"),
            F.min("fecha_hora").alias("primera_dispensacion"),
            F.max("fecha_hora").alias("ultima_dispensacion"),
        )
    )
