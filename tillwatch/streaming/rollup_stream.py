"""Continuously refreshed roll-ups of the note-level dispensing stream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillwatch.operators.partials import folded, moments
from tillwatch.operators.rollup import note_rollup_aggregates, rollup_notes
from tillwatch.plans.rolling import sample_deviation
from tillwatch.schemas import NOTE_COLUMNS
from tillwatch.session import materialise, scratch
from tillwatch.sources.tables import upsert_partitions


@dataclass(frozen=True)
class RefreshPolicy:
    """Bucket width, how late a record may arrive, and how often the table is refreshed."""

    width: str
    column: str
    lateness: str
    every: str


# The three refresh policies.
POLICIES = {
    "15min": RefreshPolicy("15 minutes", "bucket_15min", "1 hour", "5 minutes"),
    "30min": RefreshPolicy("30 minutes", "bucket_30min", "2 hours", "10 minutes"),
    "1hora": RefreshPolicy("1 hour", "bucket_1hora", "6 hours", "15 minutes"),
}
KEYS = ["cod_cajero", "cod_admin_efectivo"]


def rollup_stream(dispensed: DataFrame, policy: RefreshPolicy) -> DataFrame:
    """The roll-up over a stream; rows later than the policy allows are dropped by the watermark."""
    timed = dispensed.withColumn("fecha_hora", F.col("fecha_hora").cast("timestamp"))
    return (
        timed.withWatermark("fecha_hora", policy.lateness)
        .groupBy(F.window("fecha_hora", policy.width), *KEYS)
        .agg(*note_rollup_aggregates())
        .withColumn(policy.column, F.col("window.start").cast("timestamp_ntz"))
        .drop("window")
    )


def maintain_rollup(
    spark: SparkSession,
    dispensed: DataFrame,
    policy: RefreshPolicy,
    target: str,
    checkpoint: str,
    once: bool = False,
) -> StreamingQuery:
    """Keep the roll-up table at ``target`` current: each trigger rewrites the days whose buckets changed.

    Replaying a trigger writes the same rows again, and a merge that was stopped is finished first, so a
    lost driver or executor leaves no duplicates and no gaps.
    """
    keys = [policy.column, *KEYS]

    def refresh(batch: DataFrame, _: int) -> None:
        with scratch(batch.sparkSession):
            dated = materialise(batch.withColumn("dia", F.to_date(policy.column)), "changed-buckets")
            if not dated.isEmpty():
                values = [c for c in dated.columns if c not in keys and c != "dia"]
                upsert_partitions(batch.sparkSession, dated, target, keys, values, "dia")

    writer = (
        rollup_stream(dispensed, policy)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(refresh)
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=policy.every)
    return writer.start()


SUMS = ["num_registros", "monto_total", "total_billetes", *[f"total_{c}" for c in NOTE_COLUMNS]]
PART = ["window", *SUMS, "monto_maximo", "monto_minimo", "momentos"]


def _wider(rows: DataFrame, width: str, *parts: Column) -> DataFrame:
    """Windows made of the closed windows in ``rows``, each timed by its end."""
    return rows.groupBy(F.window(F.window_time("window"), width), *KEYS).agg(
        *[F.sum(c).alias(c) for c in SUMS],
        F.max("monto_maximo").alias("monto_maximo"),
        F.min("monto_minimo").alias("monto_minimo"),
        folded(F.collect_list("momentos")).alias("momentos"),
        *parts,
    )


def chained_rollups(dispensed: DataFrame, lateness: str = "6 hours") -> DataFrame:
    """Closed hours of a stream, with the halves and quarters (``medias``, ``cuartos``) they are made of.

    Records are read and aggregated once, to 15 minutes; half hours are made of closed quarters and hours of closed halves,
    so the wider windows keep at most two rows a key. The watermark closes a window, and with it the next wider one.
    """
    timed = dispensed.withColumn("fecha_hora", F.col("fecha_hora").cast("timestamp")).withWatermark("fecha_hora", lateness)
    quarter = timed.groupBy(F.window("fecha_hora", POLICIES["15min"].width), *KEYS).agg(*note_rollup_aggregates(), moments("monto_total").alias("momentos"))
    half = _wider(quarter.select(*KEYS, *PART), POLICIES["30min"].width, F.collect_list(F.struct(*PART)).alias("cuartos"))
    whole = F.collect_list(F.struct(*PART)).alias("medias")
    return _wider(half, POLICIES["1hora"].width, whole, F.flatten(F.collect_list("cuartos")).alias("cuartos"))


def _stored(rows: DataFrame, column: str) -> DataFrame:
    """Rows of ``chained_rollups`` in the columns of the roll-up tables."""
    named = rows.withColumns(
        {
            "monto_promedio": F.when(F.col("momentos.n") > 0, F.col("momentos.my")),
            "monto_std": sample_deviation(F.col("momentos")),
            column: F.col("window.start").cast("timestamp_ntz"),
        }
    )
    return named.withColumn("dia", F.to_date(column)).drop("window", "momentos")


def maintain_rollups(spark: SparkSession, dispensed: DataFrame, targets: dict[str, str], checkpoint: str, lateness: str = "6 hours", every: str = "15 minutes", once: bool = False) -> StreamingQuery:
    """Keep the three roll-up tables (paths by the names in ``POLICIES``) from one stream: an hour is stored when it is closed.

    A trigger that is repeated merges the same rows again. For tables that show open buckets too see ``maintain_rollup``.
    """

    def store(batch: DataFrame, _: int) -> None:
        with scratch(batch.sparkSession):
            closed = materialise(batch, "closed-hours")
            if closed.isEmpty():
                return
            parts = {"1hora": closed.drop("medias", "cuartos"), "30min": closed.select(*KEYS, F.inline("medias")), "15min": closed.select(*KEYS, F.inline("cuartos"))}
            for name, rows in parts.items():
                column = POLICIES[name].column
                dated = materialise(_stored(rows, column), f"rollup-{name}")
                values = [c for c in dated.columns if c not in (column, *KEYS, "dia")]
                upsert_partitions(batch.sparkSession, dated, targets[name], [column, *KEYS], values, "dia")

    writer = chained_rollups(dispensed, lateness).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(store)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def append_rollup(
    dispensed: DataFrame, policy: RefreshPolicy, target: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Write each bucket once, when no more records for it can arrive."""
    writer = (
        rollup_stream(dispensed, policy)
        .withColumn("dia", F.to_date(policy.column))
        .writeStream.outputMode("append")
        .format("parquet")
        .partitionBy("dia")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=policy.every)
    return writer.start()


def refresh_range(spark: SparkSession, dispensed: DataFrame, policy: RefreshPolicy, target: str, start, end) -> None:
    """Recompute the days of [start, end) from the stored records: the way back in for late data."""
    ts = F.col("fecha_hora")
    low = F.date_trunc("day", F.lit(start).cast("timestamp_ntz")).cast("timestamp_ntz")
    rows = dispensed.filter((ts >= low) & (F.to_date(ts) <= F.to_date(F.lit(end).cast("timestamp_ntz"))))
    fresh = rollup_notes(rows, policy.width, policy.column).withColumn("dia", F.to_date(policy.column))
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dia").parquet(target)


