"""Per-transaction features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.functions.calendar import is_dawn, is_night, is_weekend
from tillwatch.plans.skew import hourly, lookup_join, micros, with_previous
from tillwatch.schemas import (
    DISPENSING_TYPES,
    OPERATION_CODES,
    PIN_CHANGE,
    STATE_OK,
    STATE_REJECTED,
    TRANSACTION_FEATURES,
)

MAX_WITHDRAWAL = 2_000_000
FAST_SECONDS = 10
HOURS_IN_PERIOD = 24 * 30


def with_calendar(transactions: DataFrame) -> DataFrame:
    ts = "fecha_transaccion"
    return transactions.withColumns(
        {
            "hora": F.hour(ts),
            "dia_semana": F.weekday(ts),
            "es_fin_de_semana": is_weekend(ts),
            "es_horario_nocturno": is_night(ts),
            "es_madrugada": is_dawn(ts),
        }
    )


def with_value_flags(transactions: DataFrame) -> DataFrame:
    codes = F.create_map(*[F.lit(v) for pair in OPERATION_CODES.items() for v in pair])
    state = F.col("cod_estado_transaccion")
    kind = F.col("tipo_operacion")
    return transactions.withColumns(
        {
            "diferencia_valor": F.col("valor_transaccion") - F.col("valor_transaccion_original"),
            "es_retiro_maximo": F.coalesce(
                (F.col("valor_transaccion") >= MAX_WITHDRAWAL) & kind.isin(DISPENSING_TYPES), F.lit(False)
            ),
            "tipo_operacion_encoded": F.try_element_at(codes, kind),
            "transaccion_exitosa": F.coalesce(state == STATE_OK, F.lit(False)),
            "transaccion_rechazada": F.coalesce(state == STATE_REJECTED, F.lit(False)),
            "es_cambio_pin": F.coalesce(kind == PIN_CHANGE, F.lit(False)),
        }
    )


def with_gap(transactions: DataFrame, hours: DataFrame | None = None) -> DataFrame:
    """Seconds since the previous transaction at the machine, and whether that is fast."""
    gap = (micros("fecha_transaccion") - micros("_previa")) / F.lit(1_000_000)
    return (
        with_previous(transactions, ["cod_terminal"], "fecha_transaccion", ["id_tlf"], "_previa", hours=hours)
        .withColumn("tiempo_desde_anterior_seg", gap)
        .withColumn(
            "es_transaccion_rapida", F.coalesce(F.col("tiempo_desde_anterior_seg") < FAST_SECONDS, F.lit(False))
        )
        .drop("_previa")
    )


def machine_hours(transactions: DataFrame) -> DataFrame:
    """Counts, moments and edges per machine and hour: the one pass that the slices and the statistics come from."""
    amount = "valor_transaccion"
    return hourly(
        transactions,
        ["cod_terminal"],
        "fecha_transaccion",
        _first=F.min("fecha_transaccion"),
        _ids=F.count("id_tlf"),
        _rejected=F.count_if(F.col("cod_estado_transaccion") == STATE_REJECTED),
        _amounts=F.count(amount),
        _mean=F.avg(amount),
        _variance=F.var_pop(amount),
    )


def machine_statistics(transactions: DataFrame, hours: DataFrame | None = None) -> DataFrame:
    """Per machine: count, mean and deviation of the amount, rejection rate, mean gap.

    The gaps between consecutive rows add up to last minus first, so their mean
    needs no ordered window. Deviations of hours are merged around the machine's mean.
    """
    hours = machine_hours(transactions) if hours is None else hours
    machine = Window.partitionBy("cod_terminal")
    weight = F.coalesce(F.col("_mean"), F.lit(0.0)) * F.col("_amounts")
    mean = F.try_divide(F.sum(weight).over(machine), F.sum("_amounts").over(machine))
    squares = F.col("_amounts") * (F.col("_variance") + (F.col("_mean") - F.col("_all")) * (F.col("_mean") - F.col("_all")))
    first, last = F.min(micros("_first")), F.max(micros("_last"))
    n, amounts = F.sum("_n"), F.sum("_amounts")
    return hours.withColumn("_all", mean).groupBy("cod_terminal").agg(
        F.sum("_ids").alias("tx_total_cajero"),
        F.max("_all").alias("monto_promedio_cajero"),
        F.when(amounts > 1, F.sqrt(F.sum(squares) / (amounts - 1))).alias("monto_std_cajero"),
        (F.sum("_rejected") / n).alias("tasa_rechazo_cajero"),
        F.try_divide((last - first) / F.lit(1_000_000), n - 1).alias("velocidad_promedio_cajero"),
    )


def with_machine_statistics(transactions: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    """Attach the machine's statistics, its hourly rate and the amount's deviation."""
    if statistics is None:
        statistics = machine_statistics(transactions)
    return lookup_join(transactions, statistics, ["cod_terminal"], derived=True).withColumns(
        {
            "desviacion_monto_cajero": (F.col("valor_transaccion") - F.col("monto_promedio_cajero"))
            / (F.col("monto_std_cajero") + 1),
            "tx_por_hora_cajero": F.col("tx_total_cajero") / F.lit(HOURS_IN_PERIOD),
        }
    )


def with_machine_flags(transactions: DataFrame, machines: DataFrame) -> DataFrame:
    """Attach two flags of the machine master as 0/1; unknown machines get 0."""
    master = machines.select(
        F.col("codigo").cast("string").alias("_codigo"),
        F.col("cajero_adyacente_oficina").cast("int").alias("_adyacente"),
        F.col("cierre_nocturno").cast("int").alias("_nocturno"),
    )
    return (
        lookup_join(transactions.withColumn("_codigo", F.col("cod_terminal").cast("string")), master, ["_codigo"])
        .withColumn("cajero_adyacente_encoded", F.coalesce("_adyacente", F.lit(0)))
        .withColumn("cierre_nocturno_encoded", F.coalesce("_nocturno", F.lit(0)))
        .drop("_codigo", "_adyacente", "_nocturno")
    )


def transaction_features(transactions: DataFrame, machines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The whole per-transaction feature table in its stored types."""
    hours = machine_hours(transactions)
    rows = with_value_flags(with_calendar(transactions))
    rows = with_machine_flags(with_machine_statistics(with_gap(rows, hours), machine_statistics(transactions, hours)), machines)
    rows = rows.withColumnRenamed("id_tlf", "id_transaccion")
    return rows.select(*[stored(c, t) for c, t in TRANSACTION_FEATURES.items()], *keep)


def stored(column: str, kind: str):
    """A feature column as it is written: whole numbers and flags have no nulls."""
    value = F.col(column).cast(kind)
    if kind == "int":
        value = F.coalesce(value, F.lit(0))
    elif kind == "boolean":
        value = F.coalesce(value, F.lit(False))
    return value.alias(column)
