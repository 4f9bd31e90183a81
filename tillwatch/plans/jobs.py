"""The three jobs a user runs: build the history, detect on buckets, watch 15-minute files.

Every step reads stored tables and writes stored tables, so a job can be
resumed after any step and each large table is computed once.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillwatch.operators.alerts import build_alerts
from tillwatch.operators.buckets import bucket_features
from tillwatch.operators.behaviour import blended_scores, rule_scores
from tillwatch.operators.isolation_forest import Forest, fit_bucket_forest, fit_forest, fit_machine_forest, load_forest
from tillwatch.operators.machine_profile import machine_profile
from tillwatch.operators.neighbours import zone_features
from tillwatch.operators.partials import profile_of, rollup_states, summary_of, transaction_states
from tillwatch.operators.reasons import anomalous_transactions, explain_transactions
from tillwatch.operators.rollup import bucket_totals, machine_summary, rollup_transactions
from tillwatch.operators.transactions import transaction_features
from tillwatch.schemas import OPERATION_CODES, TRANSACTION_MODEL_FEATURES
from tillwatch.sources.fact_load import insert_if_absent, prepare_fact, rename_headings
from tillwatch.sources.machines import replace_machines
from tillwatch.sources.monthly_extracts import ingest_months, read_consolidated
from tillwatch.sources.tables import (
    SUMMARY_UPDATES,
    exists,
    finish_switch,
    merge_rows,
    read_table,
    remove,
    replace_table,
    stored_table,
    switch_table,
    upsert_alerts,
)
from tillwatch.session import materialise
from tillwatch.streaming.file_stream import score_machines, watch_files
from tillwatch.streaming.recent_mean import totals_stream, watch_recent, watch_totals

# Names of the stored tables.
CONSOLIDATED = "transacciones_consolidadas"
QUARANTINE = "cuarentena"
FACT = "transacciones"
MACHINES = "cajeros"
ROLLUP = "mv_dispensacion_por_cajero_15min"
SUMMARY = "features_dispensacion"
PROFILE = "features_ml"
BUCKETS = "features_temporales"
FACT_STATES = "estados_transacciones"
ROLLUP_STATES = "estados_mv_15min"
TRANSACTIONS = "features"
SCORES = "scores"
REASONS = "razones_anomalias"
ALERTS = "alertas_dispensacion"
TOTALS = "totales_15min"


def load_extracts(
    spark: SparkSession,
    extracts: str,
    months: Sequence[str],
    base: str,
    keep_months: int = 24,
    as_of: datetime | None = None,
    types: Sequence[str] = tuple(OPERATION_CODES),
    by_line: bool = False,
    by_index: bool = False,
) -> tuple[DataFrame, dict[str, int]]:
    """Monthly CSV folders to the transaction fact; returns the ingest errors and the insert counts.

    Only the given months are read. A file with a bad line is skipped, or, ``by_line``, the line is: it is kept in the table ``cuarentena``. ``types`` are the operation types the fact keeps, by default all that the rules need.
    ``by_index`` inserts through bitmaps of the stored keys (``insert_if_absent``).
    """
    errors = ingest_months(spark, extracts, months, f"{base}/{CONSOLIDATED}", f"{base}/{QUARANTINE}" if by_line else None)
    raw = read_consolidated(spark, f"{base}/{CONSOLIDATED}")
    as_of = as_of or rename_headings(raw).select(F.max("fecha_transaccion")).first()[0]
    raw = raw.filter(F.col("mes_origen").isin(list(months)))
    fact = prepare_fact(raw, keep_months, types, as_of)
    return errors, insert_if_absent(spark, fact, f"{base}/{FACT}", unique=True, times=rename_headings(raw), by_index=by_index)


def load_machines(spark: SparkSession, path: str, base: str) -> DataFrame:
    machines = replace_machines(spark, path, f"{base}/{MACHINES}")
    return machines.withColumnRenamed("municipio", "municipio_dane") if "municipio" in machines.columns else machines


def _machines(spark: SparkSession, base: str) -> DataFrame:
    machines = read_table(spark, base, MACHINES)
    return machines.withColumnRenamed("municipio", "municipio_dane") if "municipio" in machines.columns else machines


def by_day(df: DataFrame, time: str) -> DataFrame:
    """With the day as last column, rows of a day together: the layout of the large tables."""
    return df.withColumn("dia", F.to_date(time)).hint("rebalance", "dia")


def read_days(spark: SparkSession, base: str, name: str, start, end) -> DataFrame:
    """The days [start, end] of a table stored by day; other days are not read."""
    return read_table(spark, base, name).filter(F.col("dia").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def build_history(spark: SparkSession, base: str) -> None:
    """Fact to roll-up, machine summary and machine features."""
    fact = read_table(spark, base, FACT)
    replace_table(by_day(rollup_transactions(fact), "bucket_15min"), base, ROLLUP, ["dia"])
    _store_summary(spark, base, machine_summary(fact))
    profile = machine_profile(read_table(spark, base, ROLLUP).drop("dia"))
    located = zone_features(profile, _machines(spark, base)).withColumn("fecha_calculo", F.current_timestamp())
    replace_table(located, base, PROFILE)


def _store_summary(spark: SparkSession, base: str, summary: DataFrame) -> None:
    """Merge into the stored summary; known machines keep their weekday means.

    The merged table is written beside the stored one and then takes its place; a run that stopped in between is finished by the next one.
    """
    named = summary.select(
        F.col("cod_terminal").cast("string").alias("cod_cajero"),
        "*",
        F.col("fecha_primera_transaccion").alias("fecha_primer_registro"),
        F.col("fecha_ultima_transaccion").alias("fecha_ultimo_registro"),
        F.current_timestamp().alias("fecha_calculo"),
    ).drop("cod_terminal", "fecha_primera_transaccion", "fecha_ultima_transaccion")
    finish_switch(spark, base, SUMMARY)
    stored = stored_table(spark, f"{base}/{SUMMARY}")
    switch_table(named if stored is None else merge_rows(stored, named, ["cod_cajero"], SUMMARY_UPDATES), base, SUMMARY)


def update_history(spark: SparkSession, base: str, days: Sequence[date]) -> None:
    """Roll-up, machine summary and machine features after new or changed rows of the fact on ``days``.

    Only these days of the fact and of the roll-up are read and written; summary and features are then added up from the
    stored states of all days (one row per machine and day), which the first run builds. What states only estimate is
    said in ``partials.profile_of``; ``build_history`` gives all of it exactly.
    """
    if not exists(spark, f"{base}/{ROLLUP_STATES}/_SUCCESS"):
        build_states(spark, base)
    fact = read_table(spark, base, FACT).filter(F.col("dia").isin(list(days))).drop("dia")
    _replace_days(by_day(rollup_transactions(fact), "bucket_15min"), base, ROLLUP, days)
    _replace_days(transaction_states(fact), base, FACT_STATES, days)
    fresh = read_table(spark, base, ROLLUP).filter(F.col("dia").isin(list(days))).drop("dia")
    _replace_days(rollup_states(fresh), base, ROLLUP_STATES, days)
    _store_summary(spark, base, summary_of(read_table(spark, base, FACT_STATES)))
    profile = profile_of(read_table(spark, base, ROLLUP_STATES))
    located = zone_features(profile, _machines(spark, base)).withColumn("fecha_calculo", F.current_timestamp())
    replace_table(located, base, PROFILE)


def build_states(spark: SparkSession, base: str) -> None:
    """States of every day of the fact and of the roll-up."""
    replace_table(transaction_states(read_table(spark, base, FACT).drop("dia")), base, FACT_STATES, ["dia"])
    replace_table(rollup_states(read_table(spark, base, ROLLUP).drop("dia")), base, ROLLUP_STATES, ["dia"])


def _replace_days(rows: DataFrame, base: str, name: str, days: Sequence[date]) -> None:
    """Put the given days of a table in the place of the old ones; a day without rows becomes empty."""
    rows = materialise(rows, name)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dia").parquet(f"{base}/{name}")
    kept = {r[0] for r in rows.select("dia").distinct().collect()}  # at most the given days
    for day in set(days) - kept:
        remove(rows.sparkSession, f"{base}/{name}/dia={day}")


def build_transaction_features(spark: SparkSession, base: str) -> None:
    fact = read_table(spark, base, FACT)
    features = transaction_features(fact, _machines(spark, base), keep=("cod_terminal", "dia"))
    replace_table(features.hint("rebalance", "dia"), base, TRANSACTIONS, ["dia"])


def score_transactions(spark: SparkSession, base: str, trees: int = 100, sample: int = 0, **limits: dict) -> Forest:
    """Rule scores, model scores and their blend for all transactions of the fact: the table ``scores``.

    The model is a forest over the stored transaction features; its score is 0 to 1, 1 the most anomalous row of training.
    """
    fact, features = read_table(spark, base, FACT), read_table(spark, base, TRANSACTIONS)
    dated = features.withColumn("fecha", F.col("dia").cast("timestamp_ntz"))
    forest = fit_forest(dated, TRANSACTION_MODEL_FEATURES, ["id_transaccion"], trees=trees, sample=sample, time="fecha")
    forest.save(spark, f"{base}/modelo_transacciones")
    model = forest.transform(features).select("id_transaccion", (F.col("score_anomalia") / 100).alias("score_isolation_forest"))
    rules = rule_scores(fact, _machines(spark, base), **limits)
    replace_table(blended_scores(rules, model).withColumn("fecha_scoring", F.current_timestamp()), base, SCORES)
    return forest


def build_reasons(spark: SparkSession, base: str) -> None:
    """Reasons of the scored transactions."""
    anomalies = anomalous_transactions(
        read_table(spark, base, SCORES), read_table(spark, base, FACT), read_table(spark, base, TRANSACTIONS).drop("cod_terminal", "dia")
    )
    replace_table(explain_transactions(anomalies), base, REASONS)


def detect_on_buckets(
    spark: SparkSession, base: str, baseline: str = "trailing", contamination: float = 0.01, **options
) -> Forest:
    """Bucket features, model and merged alerts from the stored roll-up."""
    totals = bucket_totals(read_table(spark, base, ROLLUP).drop("dia"), with_baseline=True)
    features = bucket_features(totals, baseline=baseline).withColumn("dia", F.to_date("bucket_15min"))
    replace_table(features.hint("rebalance", "dia"), base, BUCKETS, ["dia"])
    features = read_table(spark, base, BUCKETS)
    forest = fit_bucket_forest(features, contamination, **options)
    forest.save(spark, f"{base}/modelo_ventanas")
    upsert_alerts(spark, build_alerts(forest.transform(features).filter("es_anomalia")), f"{base}/{ALERTS}")
    return forest


def fit_machine_model(spark: SparkSession, base: str, **options) -> Forest:
    forest = fit_machine_forest(read_table(spark, base, PROFILE), **options)
    forest.save(spark, f"{base}/modelo_cajeros")
    return forest


def _scored_profile(spark: SparkSession, base: str) -> DataFrame:
    scored = score_machines(read_table(spark, base, PROFILE), load_forest(spark, f"{base}/modelo_cajeros"))
    return materialise(scored, "scored-profile")


def watch(spark: SparkSession, base: str, folder: str, once: bool = False) -> StreamingQuery:
    """Score 15-minute files as they arrive with the machine model and features that are stored at that time."""
    return watch_files(
        spark, folder, lambda: _scored_profile(spark, base), f"{base}/{ALERTS}_15min", f"{base}/_estado_15min", once=once
    )


def watch_live(spark: SparkSession, base: str, folder: str, once: bool = False) -> list[StreamingQuery]:
    """As ``watch``, with the live recent mean in rule 3: files to totals, totals to alerts.

    With ``once`` the second query is started when the first has ended.
    """
    totals = f"{base}/{TOTALS}"
    files = watch_totals(spark, folder, totals, f"{base}/_estado_totales", once=once)
    if once:
        files.awaitTermination()
    alerts = watch_recent(totals_stream(spark, totals), lambda: _scored_profile(spark, base), f"{base}/{ALERTS}_15min", f"{base}/_estado_recientes", once=once)
    return [files, alerts]
