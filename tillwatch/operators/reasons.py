"""Reasons of anomalous transactions, one row per reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.functions.text import fixed, grouped, two_digits

# Short weekday names, Monday first.
SHORT_DAYS = ["Lun", "Mar", "Mie", "Jue", "Vie", "Sáb", "Dom"]

# Keywords of each reason type, the first type that matches wins.
TYPE_KEYWORDS = {
    "temporal": ["horario", "madrugada"],
    "monto": ["monto", "retiro", "σ"],
    "velocidad": ["velocidad", "segundos", "frecuencia"],
    "operacion": ["pin", "rechazada"],
    "ubicacion": ["cajero", "aislado"],
    "ml": ["patrón", "ml"],
}


def _has(text: Column, *words: str) -> Column:
    lowered = F.lower(text)
    found = F.lit(False)
    for word in words:
        found = found | lowered.contains(word)
    return found


def reason_type(text: Column) -> Column:
    chain = F.lit("otro")
    for name, words in reversed(TYPE_KEYWORDS.items()):
        chain = F.when(_has(text, *words), name).otherwise(chain)
    return chain


def reason_severity(text: Column, fast: Column, deviation: Column) -> Column:
    """Weight 4-9 of a reason by its wording."""
    return (
        F.when(_has(text, "madrugada") & _has(text, "cerrado"), 9)
        .when(_has(text, "retiro máximo") | _has(text, "segundos después"), 8)
        .when(_has(text, "cambio de pin") & ~F.coalesce(fast, F.lit(False)), 5)
        .when(_has(text, "σ") & (F.abs(deviation) > 3), 7)
        .when(_has(text, "alta frecuencia"), 6)
        .when(_has(text, "aislado"), 5)
        .otherwise(4)
    )


def _texts() -> list[Column]:
    """Every reason in order; null where it does not hold."""
    hour = F.concat(two_digits(F.col("hora")), F.lit(":00"))
    day = F.get(F.array(*[F.lit(d) for d in SHORT_DAYS]), F.col("dia_semana"))
    deviation, difference = F.col("desviacion_monto_cajero"), F.col("diferencia_valor")
    rate, rejected = F.col("tx_por_hora_cajero"), F.col("tasa_rechazo_cajero")

    def when(condition: Column, *parts: str | Column) -> Column:
        return F.when(condition, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))

    return [
        when(
            F.col("es_horario_nocturno") & (F.col("cierre_nocturno_encoded") != 0),
            "Transacción a las ",
            hour,
            " en cajero que cierra de noche",
        ),
        when(F.col("es_madrugada"), "Transacción en madrugada (", hour, ")"),
        when(F.col("es_fin_de_semana"), "Transacción en fin de semana (", day, ")"),
        when(F.col("es_retiro_maximo"), "Retiro máximo: $", grouped(F.col("valor_transaccion"))),
        when(
            F.abs(deviation) > 3,
            "Monto ",
            fixed(F.abs(deviation), 1),
            "σ ",
            F.when(deviation > 0, "por encima").otherwise("por debajo"),
            " del promedio del cajero",
        ),
        when(F.abs(difference) > 1000, "Diferencia entre valor original y final: $", grouped(difference)),
        when(
            F.col("es_transaccion_rapida"),
            "Transacción ",
            fixed(F.col("tiempo_desde_anterior_seg"), 0),
            " segundos después de la anterior",
        ),
        when(rate > 30, "Alta frecuencia en cajero: ", fixed(rate, 0), " tx/hora"),
        when(F.col("es_cambio_pin"), "Cambio de PIN detectado"),
        when(F.col("transaccion_rechazada"), "Transacción rechazada"),
        when(rejected > 0.3, "Cajero con alta tasa de rechazo: ", fixed(rejected * 100, 1), "%"),
        when(F.col("cajero_adyacente_encoded") == 0, "Cajero aislado (no adyacente a oficina)"),
        when(
            F.col("score_final") > 0.7,
            "Patrón anómalo detectado por ML (score: ",
            fixed(F.col("score_final"), 3),
            ")",
        ),
    ]


def anomalous_transactions(
    scores: DataFrame,
    transactions: DataFrame,
    features: DataFrame,
    levels: tuple[str, ...] = ("Crítico", "Advertencia"),
) -> DataFrame:
    """Scores of the given levels joined to their transaction and features.

    All three tables hold one row per transaction, so no join key is hot.
    """
    scored = scores.filter(F.col("nivel_anomalia").isin(list(levels))).select(
        "id_transaccion", "score_final", "nivel_anomalia"
    )
    details = transactions.select(
        F.col("id_tlf").alias("id_transaccion"),
        "fecha_transaccion",
        "cod_terminal",
        "tipo_operacion",
        "valor_transaccion",
    )
    return scored.join(details, "id_transaccion").join(features, "id_transaccion")


def explain_transactions(anomalies: DataFrame) -> DataFrame:
    """One row per reason: type, text, severity and position."""
    texts = F.filter(F.array(*_texts()), lambda t: t.isNotNull())
    return (
        anomalies.select(
            "id_transaccion",
            F.posexplode(texts).alias("_pos", "descripcion"),
            "es_transaccion_rapida",
            "desviacion_monto_cajero",
        )
        .withColumn("tipo_razon", reason_type(F.col("descripcion")))
        .withColumn(
            "severidad",
            reason_severity(
                F.col("descripcion"), F.col("es_transaccion_rapida"), F.col("desviacion_monto_cajero")
            ),
        )
        .select("id_transaccion", "tipo_razon", "descripcion", "severidad", (F.col("_pos") + 1).alias("orden"))
    )
