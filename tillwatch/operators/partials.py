"""Partial states per machine and day, and the summaries and profiles they add up to.

A day of input gives one state a machine: counts, moments (count, mean, sum of squared deviations), extremes and a
quantile sketch. States of any days merge into what those days together would give, so a new day
touches its own input only, and a machine's history is as many states as it has days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.functions.calendar import sunday_weekday
from tillwatch.functions.numbers import regression_p_value
from tillwatch.operators.machine_profile import AMOUNT, KEY, MIN_TREND_ROWS
from tillwatch.operators.rollup import WEEKDAY_COLUMNS, dispensing
from tillwatch.plans.rolling import merged, sample_deviation

DAY = "dia"
#: Size of the quantile sketches; the error of a rank is about 1.65 / SKETCH.
SKETCH = 200
#: Ranks at which a merged sketch is read to count outliers.
GRID = 1000
#: What the states of days do not add up to exactly.
ESTIMATES = [
    "q25", "dispensacion_mediana", "q75", "iqr", "pct_anomalias_2std", "pct_anomalias_3std",
    "anomalias_2std", "anomalias_3std", "anomalias_4std", "volatilidad_reciente", "volatilidad_promedio", "cambio_reciente_pct",
]

# Hours of the parts of a day.
DAY_PARTS = {"madrugada": (0, 5), "manana": (6, 11), "tarde": (12, 17), "noche": (18, 23)}

MOMENTS = "struct<n: bigint, my: double, syy: double>"
LINE_MOMENTS = "struct<n: bigint, my: double, syy: double, mx: double, sxx: double, sxy: double>"


def moments(y: str | Column, x: str | Column | None = None) -> Column:
    """Aggregate: count, mean and sum of squared deviations of ``y``; with ``x`` also of it, and the cross sum."""
    n = F.count(y)
    zero = F.lit(0.0)
    parts = [n.alias("n"), F.coalesce(F.avg(y), zero).alias("my"), F.coalesce(F.var_pop(y) * n, zero).alias("syy")]
    if x is not None:
        parts += [F.coalesce(F.avg(x), zero).alias("mx"), F.coalesce(F.var_pop(x) * n, zero).alias("sxx"), F.coalesce(F.covar_pop(x, y) * n, zero).alias("sxy")]
    return F.struct(*parts)


def folded(states: Column) -> Column:
    """An array of moments as one; of no states null."""
    return F.aggregate(states, F.lit(None).cast(MOMENTS), lambda a, b: merged(a, b))


def chained(states: Column) -> Column:
    """Moments of a line over an array in time order, in each of which x counts from 0: x goes on from one to the next."""

    def shifted(a: Column, b: Column) -> Column:
        offset = F.coalesce(a["n"], F.lit(0)).cast("double")
        moved = F.struct(b["n"].alias("n"), b["my"].alias("my"), b["syy"].alias("syy"), (b["mx"] + offset).alias("mx"), b["sxx"].alias("sxx"), b["sxy"].alias("sxy"))
        return merged(a, moved, with_x=True)

    return F.aggregate(states, F.lit(None).cast(LINE_MOMENTS), shifted)


def transaction_states(transactions: DataFrame) -> DataFrame:
    """One state per machine and day of the successful dispensing."""
    amount, hour = F.col("valor_transaccion"), F.hour("fecha_transaccion")
    rows = dispensing(transactions).withColumn(DAY, F.to_date("fecha_transaccion"))
    return rows.groupBy(KEY, DAY).agg(
        moments(amount).alias("monto"),
        F.count(F.lit(1)).alias("filas"),
        F.sum(amount).alias("total"),
        F.max(amount).alias("maximo"),
        F.min(amount).alias("minimo"),
        *[moments(F.when(hour.between(low, high), amount)).alias(f"monto_{name}") for name, (low, high) in DAY_PARTS.items()],
        F.count_if(F.col("tipo_operacion") == "Retiro").alias("retiros"),
        F.count_if(F.col("tipo_operacion") == "Avance").alias("avances"),
        F.min("fecha_transaccion").alias("primera"),
        F.max("fecha_transaccion").alias("ultima"),
    )


def _mean(state: Column) -> Column:
    return F.when(state["n"] > 0, state["my"])


def summary_of(states: DataFrame) -> DataFrame:
    """``machine_summary`` of the days whose ``transaction_states`` are given."""
    weekday = sunday_weekday(DAY)
    grouped = states.groupBy(KEY).agg(
        *[folded(F.collect_list(c)).alias(c) for c in ("monto", *[f"monto_{p}" for p in DAY_PARTS])],
        *[folded(F.collect_list(F.when(weekday == day, F.col("monto")))).alias(f"monto_{name}") for name, day in WEEKDAY_COLUMNS.items()],
        *[F.sum(c).alias(c) for c in ("filas", "total", "retiros", "avances")],
        F.max("maximo").alias("maximo"),
        F.min("minimo").alias("minimo"),
        F.min("primera").alias("primera"),
        F.max("ultima").alias("ultima"),
    )
    return grouped.select(
        KEY,
        F.col("filas").alias("total_transacciones"),
        F.col("total").alias("monto_total_dispensado"),
        _mean(F.col("monto")).alias("dispensacion_promedio"),
        sample_deviation(F.col("monto")).alias("dispensacion_std"),
        F.col("maximo").alias("dispensacion_max"),
        F.col("minimo").alias("dispensacion_min"),
        *[_mean(F.col(f"monto_{p}")).alias(f"disp_promedio_{p}") for p in [*DAY_PARTS, *WEEKDAY_COLUMNS]],
        (F.col("retiros") / F.col("filas")).alias("ratio_retiros"),
        (F.col("avances") / F.col("filas")).alias("ratio_avances"),
        F.col("primera").alias("fecha_primera_transaccion"),
        F.col("ultima").alias("fecha_ultima_transaccion"),
    )


def rollup_states(rollup: DataFrame, sketch: int = SKETCH) -> DataFrame:
    """One state per machine and day of the 15-minute roll-up: of the day, of each of its hours, and a quantile sketch.

    Rows without an amount count in no moment, as in the profile; a machine and day is at most 96 rows a type.
    """
    order = [c for c in ("bucket_15min", "tipo_operacion") if c in rollup.columns]
    rows = rollup.withColumns({DAY: F.to_date("bucket_15min"), "_hora": F.hour("bucket_15min")})
    place = F.row_number().over(Window.partitionBy(KEY, DAY).orderBy(*order)) - 1
    rows = rows.withColumn("_lugar", place.cast("double"))
    hours = rows.groupBy(KEY, DAY, "_hora").agg(
        moments(AMOUNT, "_lugar").alias("linea"),
        F.count(F.lit(1)).alias("periodos"),
        F.sum("num_transacciones").alias("transacciones"),
        F.max(AMOUNT).alias("maximo"),
        F.min(AMOUNT).alias("minimo"),
        F.kll_sketch_agg_double(F.col(AMOUNT).cast("double"), F.lit(sketch)).alias("sketch"),
        F.min("bucket_15min").alias("primero"),
        F.max("bucket_15min").alias("ultimo"),
    )
    # Within a day x is the place in the day already, so hours merge without a shift.
    line = F.aggregate(F.array_sort(F.collect_list(F.struct("_hora", "linea"))), F.lit(None).cast(LINE_MOMENTS), lambda a, b: merged(a, b["linea"], with_x=True))
    own = F.struct(F.col("_hora").alias("hora"), F.struct(F.col("linea.n").alias("n"), F.col("linea.my").alias("my"), F.col("linea.syy").alias("syy")).alias("monto"))
    return hours.groupBy(KEY, DAY).agg(
        line.alias("linea"),
        F.array_sort(F.collect_list(own)).alias("horas"),
        F.sum("periodos").alias("periodos"),
        F.sum("transacciones").alias("transacciones"),
        F.max("maximo").alias("maximo"),
        F.min("minimo").alias("minimo"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
        F.min("primero").alias("primero"),
        F.max("ultimo").alias("ultimo"),
    )


def quantiles_of(states: DataFrame, shares: list[float], low=None, high=None) -> DataFrame:
    """(cod_terminal, valores, sketch): approximate quantiles per machine of the days [low, high], from sketches alone."""
    days = states
    if low is not None:
        days = days.where(F.col(DAY) >= F.lit(low).cast("date"))
    if high is not None:
        days = days.where(F.col(DAY) <= F.lit(high).cast("date"))
    whole = days.groupBy(KEY).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return whole.select(KEY, F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))) for s in shares]).alias("valores"), "sketch")


def profile_of(states: DataFrame) -> DataFrame:
    """The machine profile of the days whose ``rollup_states`` are given.

    Equal to ``machine_profile`` but for ``ESTIMATES``: quartiles and counts of outliers come from the merged sketches, and the
    volatility and change of a week are those of seven days instead of as many rows as a full week has.
    """
    weekend = F.weekday(DAY) >= 5
    day_moments = F.struct(F.col("linea.n").alias("n"), F.col("linea.my").alias("my"), F.col("linea.syy").alias("syy"))
    by_machine = Window.partitionBy(KEY)
    week = by_machine.orderBy(F.unix_date(DAY)).rangeBetween(-6, 0)
    states = states.withColumns(
        {
            "_semana": sample_deviation(folded(F.collect_list(day_moments).over(week))),
            "_reciente": F.datediff(F.max(DAY).over(by_machine), F.col(DAY)) < 7,
        }
    )
    days = states.groupBy(KEY).agg(
        F.max_by("_semana", DAY).alias("volatilidad_reciente"),
        F.avg("_semana").alias("volatilidad_promedio"),
        folded(F.collect_list(F.when(F.col("_reciente"), day_moments))).alias("ultimos"),
        folded(F.collect_list(F.when(~F.col("_reciente"), day_moments))).alias("anteriores"),
        chained(F.transform(F.array_sort(F.collect_list(F.struct(DAY, "linea"))), lambda s: s["linea"])).alias("linea"),
        folded(F.collect_list(F.when(weekend, day_moments))).alias("fds"),
        folded(F.collect_list(F.when(~weekend, day_moments))).alias("laboral"),
        F.sum("periodos").alias("periodos"),
        F.sum("transacciones").alias("transacciones"),
        F.max("maximo").alias("maximo"),
        F.min("minimo").alias("minimo"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
        F.min("primero").alias("primero"),
        F.max("ultimo").alias("ultimo"),
    )
    each_hour = states.select(KEY, F.inline("horas")).groupBy(KEY, "hora").agg(folded(F.collect_list("monto")).alias("monto"))
    parts = [folded(F.collect_list(F.when(F.col("hora").between(low, high), F.col("monto")))).alias(f"monto_{name}") for name, (low, high) in DAY_PARTS.items()]
    hours = each_hour.groupBy(KEY).agg(
        *parts,
        F.max_by("hora", F.struct(_mean(F.col("monto")), -F.col("hora"))).alias("hora_pico"),
        F.max(_mean(F.col("monto"))).alias("hora_pico_media"),
        F.avg(sample_deviation(F.col("monto"))).alias("std_por_hora"),
    )
    line, zero = F.col("linea"), F.lit(0.0)
    mean, std = _mean(line), sample_deviation(line)
    on_weekend, on_workday = F.coalesce(_mean(F.col("fds")), zero), F.coalesce(_mean(F.col("laboral")), zero)
    spread = F.sqrt(line["sxx"]) * F.sqrt(line["syy"])
    r = F.coalesce(F.try_divide(line["sxy"], F.nullif(spread, zero)), zero)
    enough = line["n"] > MIN_TREND_ROWS
    rows = days.join(hours, KEY)
    q25, q50, q75 = (F.kll_sketch_get_quantile_double("sketch", F.lit(s)) for s in (0.25, 0.5, 0.75))

    # Sketches answer only fixed ranks, so what lies beyond a bound is counted over a grid of them.
    grid = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit((i + 0.5) / GRID) for i in range(GRID)]))

    def outside(limit: int) -> Column:
        beyond = F.size(F.filter(F.col("_rejilla"), lambda v: F.abs(v - F.col("_media")) > limit * F.col("_des")))
        return F.when(F.col("_des") > 0, beyond / GRID * 100).otherwise(zero)

    before = _mean(F.col("anteriores"))
    change = F.coalesce(F.when(before > 0, (_mean(F.col("ultimos")) - before) / before * 100), zero)
    farthest = F.greatest(F.abs(F.col("maximo") - mean), F.abs(F.col("minimo") - mean)) / std
    rows = rows.withColumns({"_rejilla": grid, "_media": mean, "_des": std})
    return rows.select(
        F.col(KEY).cast("string").alias("cod_cajero"),
        mean.alias("dispensacion_promedio"),
        std.alias("dispensacion_std"),
        F.col("maximo").alias("dispensacion_max"),
        F.col("minimo").alias("dispensacion_min"),
        F.when(mean > 0, F.try_divide(std, mean)).otherwise(zero).alias("coef_variacion"),
        F.col("periodos").alias("num_periodos_15min"),
        F.col("transacciones").alias("transacciones_totales"),
        (F.col("transacciones") / F.col("periodos")).alias("transacciones_promedio_15min"),
        *[F.coalesce(_mean(F.col(f"monto_{p}")), zero).alias(f"disp_{p}") for p in DAY_PARTS],
        "hora_pico",
        F.col("hora_pico_media").alias("dispensacion_hora_pico"),
        on_weekend.alias("disp_fin_semana"),
        on_workday.alias("disp_laboral"),
        F.when(on_workday > 0, F.try_divide(on_weekend, on_workday)).otherwise(F.lit(1.0)).alias("ratio_fds_laboral"),
        "std_por_hora",
        F.when(enough, F.coalesce(F.try_divide(line["sxy"], F.nullif(line["sxx"], zero)), zero)).otherwise(zero).alias("tendencia_slope"),
        F.when(enough, r * r).otherwise(zero).alias("tendencia_r2"),
        F.coalesce(F.when(enough, regression_p_value(r, line["n"].cast("double"))), F.lit(1.0)).alias("tendencia_pvalue"),
        q25.alias("q25"),
        q50.alias("dispensacion_mediana"),
        q75.alias("q75"),
        (q75 - q25).alias("iqr"),
        outside(2).alias("pct_anomalias_2std"),
        outside(3).alias("pct_anomalias_3std"),
        *[F.round(outside(k) / 100 * line["n"]).cast("long").alias(f"anomalias_{k}std") for k in (2, 3, 4)],
        F.when(std > 0, farthest).otherwise(zero).alias("max_z_score_historico"),
        "volatilidad_reciente",
        "volatilidad_promedio",
        change.alias("cambio_reciente_pct"),
        F.col("primero").alias("fecha_primer_dato"),
        F.col("ultimo").alias("fecha_ultimo_dato"),
    )
