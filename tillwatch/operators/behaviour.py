"""Documented transaction rules on sequences and rates per machine, and the blended transaction score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.operators.transactions import MAX_WITHDRAWAL
from tillwatch.plans.skew import lookup_join, micros, with_lookback, with_running_count
from tillwatch.schemas import DISPENSING_TYPES, PIN_CHANGE, STATE_OK, STATE_REJECTED
from tillwatch.session import materialise

KEY, TS = "cod_terminal", "fecha_transaccion"


def withdrawal() -> Column:
    return F.col("tipo_operacion").isin(DISPENSING_TYPES) & (F.col("cod_estado_transaccion") == STATE_OK)


def frequent_pin_changes(transactions: DataFrame, more_than: int = 5, seconds: int = 3600) -> DataFrame:
    """PIN changes that are more than the allowed number within the past hour at the machine."""
    changes = transactions.filter(F.col("tipo_operacion") == PIN_CHANGE).select("id_tlf", KEY, TS)
    counted = with_lookback(changes, [KEY], TS, seconds, {"cambios_pin": F.count(F.lit(1))})
    return counted.filter(F.col("cambios_pin") > more_than)


def large_withdrawals(transactions: DataFrame, more_than: float = MAX_WITHDRAWAL, seconds: int = 600) -> DataFrame:
    """Withdrawals whose total over the past ten minutes at the machine passes the limit."""
    rows = transactions.filter(withdrawal()).select("id_tlf", KEY, TS, "valor_transaccion")
    summed = with_lookback(rows, [KEY], TS, seconds, {"monto_periodo": F.sum("valor_transaccion")})
    return summed.filter(F.col("monto_periodo") > more_than)


def high_rate(transactions: DataFrame, more_than: int = 10, seconds: int = 60) -> DataFrame:
    """Transactions that are more than the allowed number within the past minute at the machine."""
    rows = transactions.select("id_tlf", KEY, TS)
    counted = with_lookback(rows, [KEY], TS, seconds, {"transacciones_periodo": F.count(F.lit(1))})
    return counted.filter(F.col("transacciones_periodo") > more_than)


def withdrawal_after_pin_change(transactions: DataFrame, seconds: int = 300) -> DataFrame:
    """Withdrawals less than five minutes after a PIN change at the machine."""
    rows = transactions.filter(withdrawal() | (F.col("tipo_operacion") == PIN_CHANGE)).select(
        "id_tlf", KEY, TS, "tipo_operacion"
    )
    change = F.max(F.when(F.col("tipo_operacion") == PIN_CHANGE, F.col(TS)))
    seen = with_lookback(rows, [KEY], TS, seconds, {"cambio_pin": change})
    wait = (micros(TS) - micros("cambio_pin")) / F.lit(1_000_000)
    return (
        seen.filter((F.col("tipo_operacion") != PIN_CHANGE) & F.col("cambio_pin").isNotNull())
        .withColumn("segundos_desde_pin", wait)
        .filter(F.col("segundos_desde_pin") < seconds)
        .drop("tipo_operacion")
    )


def rejection_runs(transactions: DataFrame, at_least: int = 10) -> DataFrame:
    """Runs of consecutive rejections at a machine: length, first and last time.

    A run is the rejections that share the number of other rows before them.
    """
    return _runs(_numbered_rejections(transactions), at_least).drop("_otras")


def _numbered_rejections(transactions: DataFrame) -> DataFrame:
    rows = transactions.select("id_tlf", KEY, TS, "cod_estado_transaccion")
    rejected = F.coalesce(F.col("cod_estado_transaccion") == STATE_REJECTED, F.lit(False))
    numbered = with_running_count(rows, [KEY], TS, ["id_tlf"], ~rejected, "_otras")
    return numbered.filter(rejected).drop("cod_estado_transaccion")


def _runs(numbered: DataFrame, at_least: int) -> DataFrame:
    length = F.count(F.lit(1)).alias("rechazos")
    return numbered.groupBy(KEY, "_otras").agg(length, F.min(TS).alias("desde"), F.max(TS).alias("hasta")).filter(F.col("rechazos") >= at_least)


def rejections_in_runs(transactions: DataFrame, at_least: int = 10) -> DataFrame:
    """Rejections between the first and last time of a run at their machine.

    Rejections carry the number of their run, so they find it by equality. Others of the machine between those times can only be
    as old as the run's first or last, which is an equality too.
    """
    numbered = materialise(_numbered_rejections(transactions), "rejections")  # read three times below
    runs = _runs(numbered, at_least)
    ends = runs.select(KEY, F.explode(F.array("desde", "hasta")).alias(TS)).distinct().withColumn("_borde", F.lit(True))
    own = runs.select(KEY, "_otras", F.lit(True).alias("_larga"))
    met = numbered.join(own, [KEY, "_otras"], "left").join(ends, [KEY, TS], "left")
    return met.filter(F.col("_larga") | F.col("_borde")).select("id_tlf", KEY, TS)


def outside_hours(transactions: DataFrame, machines: DataFrame) -> DataFrame:
    """Transactions outside the machine's opening hours (``HH:mm`` text; unknown hours never match)."""
    rows = transactions.select("id_tlf", KEY, TS)
    return _with_hours(rows, machines, "inner").filter(_is_closed())


def _with_hours(rows: DataFrame, machines: DataFrame, how: str) -> DataFrame:
    hours = machines.select(
        F.col("codigo").cast("string").alias("_codigo"),
        F.date_format(F.try_to_timestamp("hora_apertura_atm", F.lit("H:mm")), "HH:mm").alias("abre"),
        F.date_format(F.try_to_timestamp("hora_cierre_atm", F.lit("H:mm")), "HH:mm").alias("cierra"),
    )
    return lookup_join(rows.withColumn("_codigo", F.col(KEY).cast("string")), hours, ["_codigo"], how).drop("_codigo")


def _is_closed() -> Column:
    at = F.date_format(TS, "HH:mm")
    opens, closes = F.col("abre"), F.col("cierra")
    over_midnight = (at < opens) & (at > closes)
    in_day = (at < opens) | (at > closes)
    return F.when(opens <= closes, in_day).otherwise(over_midnight)


# What a transaction scores for each rule it meets, by the rule's level (critical, warning).
RULE_SCORES = {
    "cambios_pin": 1.0,
    "retiro_grande": 1.0,
    "velocidad": 1.0,
    "pin_y_retiro": 1.0,
    "rechazos": 0.6,
    "fuera_de_horario": 0.6,
}


# The limits of the rules that look back over all transactions of a machine.
RATE_LIMITS = {
    "retiro_grande": {"more_than": MAX_WITHDRAWAL, "seconds": 600},
    "velocidad": {"more_than": 10, "seconds": 60},
    "pin_y_retiro": {"seconds": 300},
}


def rate_rules(transactions: DataFrame, **limits: dict) -> DataFrame:
    """Rows with the outcome of ``large_withdrawals``, ``high_rate`` and ``withdrawal_after_pin_change`` as the columns named
    in ``RATE_LIMITS``, from one look-back; rows without a time are left out."""
    limit = {name: {**given, **limits.get(name, {})} for name, given in RATE_LIMITS.items()}
    seconds = {name: given["seconds"] for name, given in limit.items()}
    taken = F.coalesce(withdrawal(), F.lit(False))
    totals = {
        "retiro_grande": F.sum(F.when(F.col("_retiro"), F.col("valor_transaccion"))),
        "velocidad": F.count(F.lit(1)),
        "pin_y_retiro": F.max(F.when(F.col("_pin"), F.col(TS))),
    }
    rows = transactions.select("id_tlf", KEY, TS, "valor_transaccion", taken.alias("_retiro"), F.coalesce(F.col("tipo_operacion") == PIN_CHANGE, F.lit(False)).alias("_pin"))
    seen = with_lookback(rows, [KEY], TS, max(seconds.values()), totals, shorter=seconds)
    wait = micros(TS) - micros("pin_y_retiro")
    met = {
        "retiro_grande": F.col("_retiro") & (F.col("retiro_grande") > limit["retiro_grande"]["more_than"]),
        "velocidad": F.col("velocidad") > limit["velocidad"]["more_than"],
        "pin_y_retiro": F.col("_retiro") & ~F.col("_pin") & (wait < seconds["pin_y_retiro"] * 1_000_000),
    }
    return seen.select("id_tlf", KEY, TS, *[F.coalesce(c, F.lit(False)).alias(name) for name, c in met.items()])


def rule_scores(transactions: DataFrame, machines: DataFrame, **limits: dict) -> DataFrame:
    """(id_transaccion, score_reglas, reglas): the highest score of the rules a transaction meets.

    All rows of ``transactions`` are returned, with 0 and no rules where none is met. ``limits`` gives arguments of
    single rules by their name, such as ``velocidad={"more_than": 20}``.
    """

    def scored(rows: DataFrame, met: dict[str, Column]) -> DataFrame:
        points = F.greatest(F.lit(0.0), *[F.when(c, RULE_SCORES[name]).otherwise(0.0) for name, c in met.items()], F.lit(0.0))
        names = F.filter(F.array(*[F.when(c, name) for name, c in met.items()]), lambda n: n.isNotNull())
        return rows.select(F.col("id_tlf").alias("id_transaccion"), points.alias("punto"), names.alias("reglas"))

    # All rows with a time come out of the look-back; the opening hours are looked up on the same rows.
    rates = _with_hours(rate_rules(transactions, **{n: limits[n] for n in RATE_LIMITS if n in limits}), machines, "left")
    parts = [
        scored(rates, {**{name: F.col(name) for name in RATE_LIMITS}, "fuera_de_horario": _is_closed()}),
        scored(transactions.filter(F.col(TS).isNull()), {"velocidad": F.lit(False)}),
        scored(frequent_pin_changes(transactions, **limits.get("cambios_pin", {})), {"cambios_pin": F.lit(True)}),
        scored(rejections_in_runs(transactions, **limits.get("rechazos", {})), {"rechazos": F.lit(True)}),
    ]
    met = reduce(DataFrame.unionAll, parts)
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("reglas"))))
    return met.groupBy("id_transaccion").agg(F.max("punto").alias("score_reglas"), names.alias("reglas"))


# Lower bounds (exclusive) of the levels of the blended transaction score.
SCORE_LEVELS = {"Crítico": 0.8, "Sospechoso": 0.5}


def blended_scores(rule_scores: DataFrame, model_scores: DataFrame) -> DataFrame:
    """Transaction scores: half rules, half model, with the level. A part that is missing counts 0."""
    both = rule_scores.select("id_transaccion", "score_reglas").join(
        model_scores.select("id_transaccion", "score_isolation_forest"), "id_transaccion", "full_outer"
    )
    rules, model = F.coalesce("score_reglas", F.lit(0.0)), F.coalesce("score_isolation_forest", F.lit(0.0))
    level = F.lit("Normal")
    for name, bound in reversed(SCORE_LEVELS.items()):
        level = F.when(F.col("score_final") > bound, name).otherwise(level)
    return both.select(
        "id_transaccion",
        rules.alias("score_reglas"),
        model.alias("score_isolation_forest"),
        (0.5 * rules + 0.5 * model).alias("score_final"),
    ).withColumn("nivel_anomalia", level)
