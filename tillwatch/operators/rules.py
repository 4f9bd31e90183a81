"""Five weighted business rules and the scoring of a 15-minute file per machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.functions.text import fixed, grouped
from tillwatch.plans.skew import anti_join, is_small, lookup_join
from tillwatch.schemas import ALERT_COLUMNS

# Weights of the rules.
WEIGHTS = {
    "regla_1_dispensacion_extrema": 0.30,
    "regla_2_horario_sospechoso": 0.25,
    "regla_3_cambio_drastico": 0.20,
    "regla_4_historial_anomalias": 0.15,
    "regla_5_patron_geografico": 0.10,
}
MODEL_WEIGHT, RULES_WEIGHT = 0.6, 0.4

# Lower bounds of the levels of the blended score.
LEVELS = {"Crítico": 0.9, "Advertencia": 0.7, "Sospechoso": 0.5}


def _rule_strengths(
    amount: Column, mean: Column, std: Column, dawn: Column, zone: Column, history: Column, hour: Column, recent: Column
) -> dict[str, tuple[Column, Column]]:
    """Per rule its strength in [0, 1] (null when it does not fire) and its text."""
    z = F.abs(F.try_divide(amount - mean, std))
    dawn_ratio = F.when(mean > 0, F.try_divide(dawn, mean)).otherwise(F.lit(0.0))
    change = F.when(recent > 0, F.try_divide(amount - recent, recent) * 100)
    return {
        "regla_1_dispensacion_extrema": (
            F.when((std > 0) & (z > 3), F.least(z / 10, F.lit(1.0))),
            F.concat(
                F.lit("Dispensación extrema: $"),
                grouped(amount),
                F.lit(" ("),
                fixed(z, 1),
                F.lit("σ del promedio $"),
                grouped(mean),
                F.lit(")"),
            ),
        ),
        "regla_2_horario_sospechoso": (
            F.when(hour.between(0, 5) & (dawn_ratio < 0.1), F.lit(1.0)),
            F.concat(
                F.lit("Dispensación en madrugada ("),
                hour.cast("string"),
                F.lit(":00h) cuando normalmente no opera"),
            ),
        ),
        "regla_3_cambio_drastico": (
            F.when(F.abs(change) > 200, F.least(F.abs(change) / 500, F.lit(1.0))),
            F.concat(
                F.lit("Cambio drástico: "),
                F.when(change > 0, "aumento").otherwise("disminución"),
                F.lit(" de "),
                fixed(F.abs(change), 0),
                F.lit("%"),
            ),
        ),
        "regla_4_historial_anomalias": (
            F.when(history > 5, F.least(history / 20, F.lit(1.0))),
            F.concat(F.lit("Historial problemático: "), fixed(history, 1), F.lit("% anomalías")),
        ),
        "regla_5_patron_geografico": (
            F.when(zone > 3, F.lit(1.0)).when(zone < 0.3, F.lit(0.7)),
            F.concat(
                F.lit("Dispensación "),
                F.when(zone > 3, "mucho mayor").otherwise("mucho menor"),
                F.lit(" que cajeros cercanos"),
            ),
        ),
    }


def business_rules(
    amount: Column,
    hour: Column,
    mean: Column | None = None,
    std: Column | None = None,
    dawn: Column | None = None,
    zone: Column | None = None,
    history: Column | None = None,
    recent: Column | None = None,
) -> Column:
    """Struct of ``score`` and ``reglas``, an array of (regla, score_parcial, texto) of the rules that fired.

    Inputs left out are read from the columns of the machine profile.
    """
    mean = F.col("dispensacion_promedio") if mean is None else mean
    rules = _rule_strengths(
        amount,
        mean,
        F.col("dispensacion_std") if std is None else std,
        F.col("disp_madrugada") if dawn is None else dawn,
        F.col("ratio_vs_zona") if zone is None else zone,
        F.col("pct_anomalias_3std") if history is None else history,
        hour,
        mean if recent is None else recent,
    )
    parts = {name: strength * F.lit(WEIGHTS[name]) for name, (strength, _) in rules.items()}
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts.values()), F.lit(0.0))
    fired = F.filter(
        F.array(
            *[
                F.struct(F.lit(name).alias("regla"), parts[name].alias("score_parcial"), text.alias("texto"))
                for name, (_, text) in rules.items()
            ]
        ),
        lambda rule: rule["score_parcial"].isNotNull(),
    )
    return F.struct(F.least(total, F.lit(1.0)).alias("score"), fired.alias("reglas"))


def blend(model_score: Column, rule_score: Column) -> Column:
    return MODEL_WEIGHT * model_score + RULES_WEIGHT * rule_score


def sigmoid_of_model(raw: Column) -> Column:
    """Raw forest score in [-1, 0] to (0.5, 0.731]; with it a blended score cannot reach 0.9."""
    return 1 / (1 + F.exp(raw))


def scaled_model(raw: Column, lowest: float, highest: float) -> Column:
    """Raw forest score to [0, 1] by the range seen in training; with it every level can be reached."""
    share = (raw - F.lit(lowest)) / F.lit((highest - lowest) or 1.0)
    return F.least(F.greatest(1 - share, F.lit(0.0)), F.lit(1.0))


def level(score: Column) -> Column:
    chain = F.lit("Normal")
    for name, bound in reversed(LEVELS.items()):
        chain = F.when(score >= bound, name).otherwise(chain)
    return chain


def file_totals(parsed: DataFrame) -> DataFrame:
    """Per file and machine: dispensed total and the time of its first line."""
    return parsed.groupBy("archivo_origen", "cod_cajero").agg(
        F.sum("monto_total").alias("monto_dispensado"),
        F.min_by("fecha_hora", "linea").alias("fecha_hora"),
    )


def with_recent_mean(totals: DataFrame, buckets: int = 4, max_age: int = 24 * 3600) -> DataFrame:
    """Totals with promedio_reciente: the mean of the machine's last ``buckets`` totals, none older than ``max_age`` seconds.

    A machine has one total a time and at most as many as there are files, so the window holds bounded rows.
    """
    before = Window.partitionBy("cod_cajero").orderBy("fecha_hora").rowsBetween(-buckets, -1)
    rows = totals.withColumn("_antes", F.collect_list(F.struct("fecha_hora", "monto_dispensado")).over(before))
    age = F.expr(f"fecha_hora - make_interval(0, 0, 0, 0, 0, 0, {max_age})")
    near = F.transform(F.filter("_antes", lambda t: t["fecha_hora"] >= age), lambda t: t["monto_dispensado"])
    mean = F.aggregate(near, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(near), F.lit(0))
    return rows.withColumn("promedio_reciente", mean).drop("_antes")


def with_history(totals: DataFrame, profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Totals joined to the machine profile, and the totals of machines without one."""
    if is_small(totals):
        known = profile.join(F.broadcast(totals), "cod_cajero")
    else:
        known = lookup_join(totals, profile, ["cod_cajero"], "inner")
    return known, anti_join(totals, profile, ["cod_cajero"])


def score_totals(
    known: DataFrame,
    raw_model_score: Column,
    min_score: float = LEVELS["Sospechoso"],
    model_range: tuple[float, float] | None = None,
    recent: Column | None = None,
) -> DataFrame:
    """Blend the model's score with the rules, grade it and keep what is anomalous.

    The raw score goes through a sigmoid, or through its training range where ``model_range`` is given. Rule 3 compares with
    ``recent``, or with the historic mean where that is null or not given.
    """
    model = scaled_model(raw_model_score, *model_range) if model_range else sigmoid_of_model(raw_model_score)
    before = None if recent is None else F.coalesce(recent, F.col("dispensacion_promedio"))
    rules = business_rules(F.col("monto_dispensado"), F.hour("fecha_hora"), recent=before)
    scored = (
        known.withColumn("_rules", rules)
        .withColumn("score_isolation_forest", model)
        .withColumn("score_reglas", F.col("_rules.score"))
        .withColumn("score_anomalia", blend(F.col("score_isolation_forest"), F.col("score_reglas")))
        .withColumn("severidad", level(F.col("score_anomalia")))
    )
    return scored.filter(F.col("score_anomalia") >= min_score)


def file_alerts(scored: DataFrame) -> DataFrame:
    """Alert rows of scored totals, with the JSON detail of scores and rules."""
    mean = F.coalesce("dispensacion_promedio", F.lit(0.0))
    texts = F.col("_rules.reglas.texto")
    fired = F.map_from_entries(
        F.transform(
            F.col("_rules.reglas"),
            lambda r: F.struct(r["regla"], F.struct(F.lit(True).alias("activada"), r["score_parcial"])),
        )
    )
    text = F.concat(
        F.lit("Cajero "),
        F.col("cod_cajero"),
        F.lit(" dispensó $"),
        grouped(F.col("monto_dispensado")),
        F.lit(" (promedio histórico: $"),
        grouped(mean),
        F.lit(")"),
    )
    description = F.concat_ws(
        ". ", text, F.when(F.size(texts) > 0, F.concat(F.lit("Razones: "), F.concat_ws("; ", texts)))
    )
    detail = F.to_json(
        F.struct(
            "score_isolation_forest",
            "score_reglas",
            F.col("score_anomalia").alias("score_final"),
            texts.alias("razones_texto"),
            fired.alias("reglas_activadas"),
        )
    )
    deviation = F.when(
        F.col("dispensacion_std") > 0, F.try_divide(F.col("monto_dispensado") - mean, F.col("dispensacion_std"))
    ).otherwise(F.lit(0.0))
    return scored.select(
        "cod_cajero",
        "fecha_hora",
        F.lit("dispensacion_anomala").alias("tipo_anomalia"),
        "severidad",
        "score_anomalia",
        "monto_dispensado",
        mean.alias("monto_esperado"),
        deviation.alias("desviacion_std"),
        description.alias("descripcion"),
        detail.alias("razones"),
        F.lit("isolation_forest+reglas").alias("modelo_usado"),
        F.current_timestamp().alias("fecha_deteccion"),
    ).select(*ALERT_COLUMNS)
