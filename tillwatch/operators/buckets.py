"""Features of each machine and 15-minute bucket.

Frames count existing buckets; ``clock_features`` has them by elapsed time. The windows by machine come
first; those by machine and hour, weekday or month reuse its partitioning, so
all of them cost one shuffle. Groups are bounded by 96 buckets per day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.functions.calendar import epoch_seconds, is_month_end, is_pay_window, is_weekend, iso_weekday
from tillwatch.functions.numbers import percent_change, z_score
from tillwatch.operators.rollup import BASELINE
from tillwatch.plans.rolling import including_current, sample_deviation, slope, with_moments_since, with_preceding_moments
from tillwatch.plans.skew import lookup_join

AMOUNT = "monto_total_dispensado"
KEY, BUCKET = "cod_terminal", "bucket_15min"
DAY_ROWS = 96
HOUR_ROWS = 28
WEEKDAY_ROWS = 4
DAY_SECONDS = 24 * 3600


def with_bucket_calendar(buckets: DataFrame) -> DataFrame:
    return buckets.withColumns(
        {
            "hora_del_dia": F.hour(BUCKET),
            "dia_semana": iso_weekday(BUCKET),
            "mes": F.month(BUCKET),
            "es_fin_de_semana": is_weekend(BUCKET),
            "es_fin_de_mes": is_month_end(BUCKET),
            "es_quincena": is_pay_window(BUCKET),
        }
    )


def with_machine_z(buckets: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Standard score against the machine's historic mean and deviation.

    They come from ``profile``, or without one from the columns ``bucket_totals`` put next to the totals.
    """
    if profile is not None:
        baseline = profile.select(F.col("cod_cajero").alias("_maquina"), *BASELINE)
        buckets = lookup_join(buckets.withColumn("_maquina", F.col(KEY).cast("string")), baseline, ["_maquina"])
    score = z_score(F.col(AMOUNT), F.col(BASELINE[0]), F.col(BASELINE[1]))
    return buckets.withColumn("z_score_vs_cajero", F.coalesce(score, F.lit(0.0))).drop("_maquina", *BASELINE)


def _by_machine():
    return Window.partitionBy(KEY).orderBy(BUCKET)


def change_from(rows: int) -> Column:
    """Percent change against the bucket ``rows`` rows earlier."""
    return percent_change(F.col(AMOUNT), F.lag(AMOUNT, rows).over(_by_machine()))


def seconds_since_first() -> Column:
    first = F.first(BUCKET).over(_by_machine().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return epoch_seconds(BUCKET) - epoch_seconds(first)


def _z_over(spec) -> Column:
    return z_score(F.col(AMOUNT), F.avg(AMOUNT).over(spec), F.stddev_samp(AMOUNT).over(spec))


def trailing_z(group: str, rows: int) -> Column:
    """Standard score against the preceding ``rows`` buckets with the same ``group`` value."""
    return _z_over(Window.partitionBy(KEY, group).orderBy(BUCKET).rowsBetween(-rows, -1))


def history_z(group: str) -> Column:
    """Standard score against all buckets with the same ``group`` value."""
    return _z_over(Window.partitionBy(KEY, group))


def change_from_time(seconds: int) -> Column:
    """Percent change against the bucket exactly ``seconds`` earlier; 0 where there is none."""
    clock = Window.partitionBy(KEY).orderBy(F.unix_seconds(F.col(BUCKET).cast("timestamp")))
    return percent_change(F.col(AMOUNT), F.max(AMOUNT).over(clock.rangeBetween(-seconds, -seconds)))


def with_changes(buckets: DataFrame, day_rows: int = DAY_ROWS, by_clock: bool = False) -> DataFrame:
    """Change against the previous bucket and against yesterday: ``day_rows`` buckets or, by the clock, 24 hours ago."""
    yesterday = change_from_time(24 * 3600) if by_clock else change_from(day_rows)
    return buckets.withColumn("cambio_vs_anterior", change_from(1)).withColumn("cambio_vs_ayer", yesterday)


def with_trend(buckets: DataFrame, day_rows: int = DAY_ROWS, min_rows: int = 2) -> DataFrame:
    """Deviation of the preceding ``day_rows`` buckets, and the slope per second of those and the current one."""
    timed = buckets.withColumn("_segundos", seconds_since_first())
    moments = with_preceding_moments(timed, KEY, [BUCKET], AMOUNT, day_rows, "_previos", "_segundos")
    together = including_current(F.col("_previos"), AMOUNT, "_segundos")
    return (
        moments.withColumn("volatilidad_reciente", sample_deviation(F.col("_previos")))
        .withColumn("_hasta_aqui", together)
        .withColumn(
            "tendencia_24h", F.when(F.col("_hasta_aqui.n") >= min_rows, slope(F.col("_hasta_aqui")))
        )
        .drop("_segundos", "_previos", "_hasta_aqui")
    )


def with_group_z(
    buckets: DataFrame, baseline: str = "trailing", hour_rows: int = HOUR_ROWS, weekday_rows: int = WEEKDAY_ROWS
) -> DataFrame:
    """Scores against the same hour and weekday, ``trailing`` rows or whole ``history``."""
    if baseline == "trailing":
        by_hour, by_day = trailing_z("hora_del_dia", hour_rows), trailing_z("dia_semana", weekday_rows)
    elif baseline == "history":
        by_hour, by_day = history_z("hora_del_dia"), history_z("dia_semana")
    else:
        raise ValueError(f"unknown baseline {baseline!r}")
    return buckets.withColumn("z_score_vs_hora", by_hour).withColumn("z_score_vs_dia_semana", by_day)


def with_clock_trend(buckets: DataFrame, min_rows: int = 2) -> DataFrame:
    """``with_trend`` over the past 24 hours by the clock: gaps stay gaps, whatever the number of buckets."""
    timed = buckets.withColumn("_segundos", epoch_seconds(BUCKET))
    moments = with_moments_since(timed, [KEY], BUCKET, AMOUNT, DAY_SECONDS, "_previos", "_segundos")
    together = including_current(F.col("_previos"), AMOUNT, "_segundos")
    return (
        moments.withColumn("volatilidad_reciente", sample_deviation(F.col("_previos")))
        .withColumn("_hasta_aqui", together)
        .withColumn("tendencia_24h", F.when(F.col("_hasta_aqui.n") >= min_rows, slope(F.col("_hasta_aqui"))))
        .drop("_segundos", "_previos", "_hasta_aqui")
    )


def with_clock_z(buckets: DataFrame, days: int = 28) -> DataFrame:
    """Scores against the buckets of the same hour, and of the same weekday, of the past ``days`` days."""
    for group, name in (("hora_del_dia", "z_score_vs_hora"), ("dia_semana", "z_score_vs_dia_semana")):
        rows = with_moments_since(buckets, [KEY, group], BUCKET, AMOUNT, days * DAY_SECONDS, "_previos")
        buckets = rows.withColumn(name, z_score(F.col(AMOUNT), F.col("_previos.my"), sample_deviation(F.col("_previos")))).drop("_previos")
    return buckets


def clock_volatility(buckets: DataFrame, days: int = 7) -> DataFrame:
    """Per machine the deviation of the past ``days`` days by the clock, this bucket included: the last and the mean."""
    rows = with_moments_since(buckets, [KEY], BUCKET, AMOUNT, days * DAY_SECONDS, "_previos")
    rows = rows.withColumn("_vol", sample_deviation(including_current(F.col("_previos"), AMOUNT)))
    return rows.groupBy(KEY).agg(F.max_by("_vol", BUCKET).alias("volatilidad_reciente"), F.avg("_vol").alias("volatilidad_promedio"))


def clock_features(buckets: DataFrame, profile: DataFrame | None = None, days: int = 28, min_rows: int = 2) -> DataFrame:
    """``bucket_features`` with every frame by elapsed time: 24 hours, and ``days`` days of the same hour or weekday."""
    rows = with_machine_z(with_bucket_calendar(buckets), profile)
    rows = with_clock_trend(with_changes(rows, by_clock=True), min_rows)
    return with_month_percentile(with_clock_z(rows, days))


def with_month_percentile(buckets: DataFrame, per_year: bool = False) -> DataFrame:
    """Percent rank (0-100) of the amount inside machine and month of the year."""
    groups = [KEY, "mes"]
    if per_year:
        buckets, groups = buckets.withColumn("_anio", F.year(BUCKET)), [*groups, "_anio"]
    rank = F.percent_rank().over(Window.partitionBy(*groups).orderBy(AMOUNT))
    return buckets.withColumn("percentil_vs_mes", rank * 100).drop("_anio")


def bucket_features(
    buckets: DataFrame,
    profile: DataFrame | None = None,
    baseline: str = "trailing",
    day_rows: int = DAY_ROWS,
    hour_rows: int = HOUR_ROWS,
    weekday_rows: int = WEEKDAY_ROWS,
) -> DataFrame:
    """All bucket features. ``history`` is the variant that also asks for ten rows before fitting a trend."""
    min_rows = 10 if baseline == "history" else 2
    rows = with_machine_z(with_bucket_calendar(buckets), profile)
    rows = with_trend(with_changes(rows, day_rows), day_rows, min_rows)
    rows = with_group_z(rows, baseline, hour_rows, weekday_rows)
    return with_month_percentile(rows)
