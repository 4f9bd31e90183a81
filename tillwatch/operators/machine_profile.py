"""Per-machine statistical profile of the 15-minute roll-up.

Each family is a set of window columns and a set of aggregates. The windows all
partition by machine (or machine and hour), so the full profile is one shuffle
on the machine followed by sorts and a final aggregate in place. A machine has
at most 96 roll-up rows per day and operation type, which bounds every group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.functions.numbers import regression_p_value
from tillwatch.plans.rolling import including_current, sample_deviation, with_preceding_moments

AMOUNT = "monto_total_dispensado"
WEEK_ROWS = 7 * 4 * 24
MIN_TREND_ROWS = 5
KEY = "cod_terminal"


def _order(df: DataFrame) -> list[str]:
    """Time order of a machine's rows; roll-up rows of one bucket go by type, bucket totals have none."""
    return [c for c in ("bucket_15min", "tipo_operacion") if c in df.columns]


def _basic() -> list[Column]:
    x = F.col(AMOUNT)
    mean, std = F.avg(x), F.stddev_samp(x)
    quartiles = F.percentile(x, [0.25, 0.5, 0.75])
    q25, q75 = quartiles[0], quartiles[2]
    return [
        mean.alias("dispensacion_promedio"),
        std.alias("dispensacion_std"),
        F.max(x).alias("dispensacion_max"),
        F.min(x).alias("dispensacion_min"),
        quartiles[1].alias("dispensacion_mediana"),
        F.when(mean > 0, F.try_divide(std, mean)).otherwise(F.lit(0.0)).alias("coef_variacion"),
        F.count(F.lit(1)).alias("num_periodos_15min"),
        F.sum("num_transacciones").alias("transacciones_totales"),
        F.avg("num_transacciones").alias("transacciones_promedio_15min"),
        q25.alias("q25"),
        q75.alias("q75"),
        (q75 - q25).alias("iqr"),
    ]


def _time_columns(df: DataFrame) -> DataFrame:
    hour = Window.partitionBy(KEY, "_hora")
    order = _order(df)
    return (
        df.withColumn("_hora", F.hour("bucket_15min"))
        .withColumn("_fila_hora", F.row_number().over(hour.orderBy(*order)))
        .withColumn("_media_hora", F.avg(AMOUNT).over(hour))
        .withColumn("_std_hora", F.stddev_samp(AMOUNT).over(hour))
    )


def _time() -> list[Column]:
    x, hour = F.col(AMOUNT), F.col("_hora")
    weekend = F.weekday("bucket_15min") >= 5

    def mean_or_zero(condition: Column) -> Column:
        return F.coalesce(F.avg(F.when(condition, x)), F.lit(0.0))

    on_weekend, on_workday = mean_or_zero(weekend), mean_or_zero(~weekend)
    return [
        mean_or_zero(hour < 6).alias("disp_madrugada"),
        mean_or_zero(hour.between(6, 11)).alias("disp_manana"),
        mean_or_zero(hour.between(12, 17)).alias("disp_tarde"),
        mean_or_zero(hour >= 18).alias("disp_noche"),
        F.max_by(hour, F.struct("_media_hora", -hour)).alias("hora_pico"),
        F.max("_media_hora").alias("dispensacion_hora_pico"),
        on_weekend.alias("disp_fin_semana"),
        on_workday.alias("disp_laboral"),
        F.when(on_workday > 0, F.try_divide(on_weekend, on_workday))
        .otherwise(F.lit(1.0))
        .alias("ratio_fds_laboral"),
        F.avg(F.when(F.col("_fila_hora") == 1, F.col("_std_hora"))).alias("std_por_hora"),
    ]


def _trend_columns(df: DataFrame, week_rows: int) -> DataFrame:
    order = _order(df)
    rows = Window.partitionBy(KEY).orderBy(*order)
    numbered = df.withColumn("_periodo", (F.row_number().over(rows) - 1).cast("double"))
    moments = with_preceding_moments(numbered, KEY, order, AMOUNT, week_rows - 1, "_previos")
    return (
        moments.withColumn("_vol", sample_deviation(including_current(F.col("_previos"), AMOUNT)))
        .drop("_previos")
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(KEY)))
    )


def _trend(week_rows: int) -> list[Column]:
    x, t, n = F.col(AMOUNT), F.col("_periodo"), F.count(F.lit(1))
    enough = n > MIN_TREND_ROWS
    spread = F.stddev_pop(x) * F.stddev_pop(t)
    r = F.coalesce(F.try_divide(F.covar_pop(x, t), F.nullif(spread, F.lit(0.0))), F.lit(0.0))
    slope = F.coalesce(F.regr_slope(x, t), F.lit(0.0))
    recent = F.col("_periodo") >= F.col("_n") - week_rows
    last_week, before = F.avg(F.when(recent, x)), F.avg(F.when(~recent, x))
    change = F.when((n > week_rows) & (before > 0), F.try_divide(last_week - before, before) * 100)
    return [
        F.when(enough, slope).otherwise(F.lit(0.0)).alias("tendencia_slope"),
        F.when(enough, r * r).otherwise(F.lit(0.0)).alias("tendencia_r2"),
        F.when(enough, r).alias("_r"),
        F.max_by("_vol", "_periodo").alias("volatilidad_reciente"),
        F.avg("_vol").alias("volatilidad_promedio"),
        F.coalesce(change, F.lit(0.0)).alias("cambio_reciente_pct"),
        n.alias("_puntos"),
    ]


def _history_columns(df: DataFrame) -> DataFrame:
    machine = Window.partitionBy(KEY)
    std = F.stddev_samp(AMOUNT).over(machine)
    z = F.abs(F.try_divide(F.col(AMOUNT) - F.avg(AMOUNT).over(machine), std))
    return df.withColumn("_z", F.when(std > 0, z))


def _history() -> list[Column]:
    def over(limit: int) -> Column:
        return F.count_if(F.col("_z") > limit)

    def share(limit: int) -> Column:
        return over(limit) / F.count(F.lit(1)) * 100

    return [
        over(2).alias("anomalias_2std"),
        over(3).alias("anomalias_3std"),
        over(4).alias("anomalias_4std"),
        share(2).alias("pct_anomalias_2std"),
        share(3).alias("pct_anomalias_3std"),
        F.coalesce(F.max("_z"), F.lit(0.0)).alias("max_z_score_historico"),
    ]


FAMILIES = ("basic", "time", "trend", "history")


def machine_profile(
    rollup: DataFrame, families: Sequence[str] = FAMILIES, week_rows: int = WEEK_ROWS
) -> DataFrame:
    """Per-machine features of the chosen families, with the first and last bucket.

    Rows are bucket x type as stored; pass ``bucket_totals`` to profile whole buckets instead.
    """
    rows, aggregates = rollup, []
    if "trend" in families:  # first: its sort also serves the unordered windows by machine
        rows = _trend_columns(rows, week_rows)
    if "history" in families:
        rows = _history_columns(rows)
    if "time" in families:
        rows = _time_columns(rows)
    if "basic" in families:
        aggregates += _basic()
    if "time" in families:
        aggregates += _time()
    if "trend" in families:
        aggregates += _trend(week_rows)
    if "history" in families:
        aggregates += _history()
    aggregates += [F.min("bucket_15min").alias("fecha_primer_dato"), F.max("bucket_15min").alias("fecha_ultimo_dato")]
    out = rows.groupBy(KEY).agg(*aggregates).withColumnRenamed(KEY, "cod_cajero")
    out = out.withColumn("cod_cajero", F.col("cod_cajero").cast("string"))
    if "trend" in families:
        p = F.when(F.col("_r").isNotNull(), regression_p_value(F.col("_r"), F.col("_puntos").cast("double")))
        out = out.withColumn("tendencia_pvalue", F.coalesce(p, F.lit(1.0))).drop("_r", "_puntos")
    return out
