"""A continuous roll-up that loses no row: what comes after the watermark goes to a side table, and from there back in.

The roll-up keeps the moments of each bucket, so a trigger merges its own rows into the days they meet and the stream needs
no state. The watermark is the query's own: the newest time of the triggers before, less the lateness allowed.
"""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillwatch.functions.calendar import bucket
from tillwatch.operators.partials import folded, moments
from tillwatch.operators.rollup import note_rollup_aggregates
from tillwatch.plans.rolling import sample_deviation
from tillwatch.session import materialise, scratch
from tillwatch.sources.tables import finish_merge, finish_switch, stored_table, switch_table, write_merge
from tillwatch.streaming.rollup_stream import KEYS, SUMS, RefreshPolicy

#: Columns that say which trigger wrote a row last; all rows of a day have the same.
WRITTEN = ["consulta", "lote"]
PARTS = [*SUMS, "monto_maximo", "monto_minimo", "momentos"]


def query_name(checkpoint: str) -> str:
    """The name under which a query, known by its checkpoint, marks what it writes."""
    return sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def _mark(checkpoint: str) -> tuple[str, str]:
    base, _, name = checkpoint.rstrip("/").rpartition("/")
    return base, f"{name}-marca"


def _time(value: datetime | None) -> Column:
    return F.lit(None if value is None else value.isoformat(sep=" ")).cast("timestamp_ntz")


def _advance(batch: DataFrame, checkpoint: str, lote: int) -> datetime | None:
    """The newest time before trigger ``lote`` (None: there was none), after noting what the trigger adds to it.

    One row is kept. A trigger that runs again finds its own row and gets the same time as at first.
    """
    spark, (base, name) = batch.sparkSession, _mark(checkpoint)
    finish_switch(spark, base, name)
    stored = stored_table(spark, f"{base}/{name}")
    row = None if stored is None else stored.first()
    before = None if row is None else (row.antes if row.lote == lote else row.hasta)
    if row is None or row.lote != lote:
        old = _time(before)
        newest = batch.agg(F.greatest(old, F.max("fecha_hora").cast("timestamp_ntz")).alias("hasta"))
        switch_table(newest.select(F.lit(lote).alias("lote"), old.alias("antes"), "hasta").coalesce(1), base, name)
    return before


def watermark(spark: SparkSession, checkpoint: str, policy: RefreshPolicy) -> datetime | None:
    """The time before which buckets are closed after all triggers so far; None before the first."""
    base, name = _mark(checkpoint)
    finish_switch(spark, base, name)
    stored = stored_table(spark, f"{base}/{name}")
    return None if stored is None else stored.select(F.col("hasta") - F.expr(f"INTERVAL {policy.lateness}")).first()[0]


def bucket_states(rows: DataFrame, policy: RefreshPolicy) -> DataFrame:
    """The roll-up of ``rows`` with the moments of each bucket and the day."""
    grouped = rows.groupBy(bucket("fecha_hora", policy.width).alias(policy.column), *KEYS)
    return grouped.agg(*note_rollup_aggregates(), moments("monto_total").alias("momentos")).drop("monto_promedio", "monto_std").withColumn("dia", F.to_date(policy.column))


def merged_states(states: DataFrame, policy: RefreshPolicy) -> DataFrame:
    """States of the same bucket as one; nulls in the key are a value like others."""
    return states.groupBy("dia", policy.column, *KEYS).agg(
        *[F.sum(c).alias(c) for c in SUMS],
        F.max("monto_maximo").alias("monto_maximo"),
        F.min("monto_minimo").alias("monto_minimo"),
        folded(F.collect_list("momentos")).alias("momentos"),
    )


def _merge(states: DataFrame, policy: RefreshPolicy, target: str, consulta: str, lote: int) -> None:
    """Add the states of a trigger to the days they meet, each day once however often the trigger runs."""
    spark = states.sparkSession
    finish_merge(spark, target, "dia")
    stored = stored_table(spark, target)
    if stored is not None:
        met = [r[0] for r in states.select("dia").distinct().collect()]  # days of one trigger
        current = stored.filter(F.col("dia").isin(met))
        ours = (F.col("consulta") == consulta) & (F.col("lote") >= lote)
        done = [r[0] for r in current.filter(ours).select("dia").distinct().collect()]
        columns = ["dia", policy.column, *KEYS, *PARTS]
        both = current.select(*columns).unionByName(states.select(*columns))
        states = merged_states(both.filter(~F.col("dia").isin(done)) if done else both, policy)
        if len(done) == len(met):
            return
    write_merge(states.withColumns({"consulta": F.lit(consulta), "lote": F.lit(lote).cast("long")}), target, "dia")


def maintain_with_late_rows(
    spark: SparkSession, dispensed: DataFrame, policy: RefreshPolicy, target: str, late: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Keep the roll-up at ``target`` current, and every record of a closed bucket in the table ``late``.

    A record is late if its bucket ended at or before the watermark, as in a windowed aggregate. ``late`` has the records
    with their day, the watermark that closed the bucket (marca), consulta and lote. Records without a time have no bucket: they
    are late by definition, with a null day. A trigger that runs again writes the same rows in the same places, so
    each record is either in the roll-up or in ``late``, once. ``read_rollup`` gives the table in the usual columns.
    """
    consulta = query_name(checkpoint)

    def store(batch: DataFrame, lote: int) -> None:
        with scratch(batch.sparkSession):
            records = materialise(batch.withColumn("fecha_hora", F.col("fecha_hora").cast("timestamp_ntz")), "arrived")
            if records.isEmpty():
                return
            before = _advance(records, checkpoint, lote)
            mark = _time(before) - F.expr(f"INTERVAL {policy.lateness}")
            # Closed are the buckets that begin before the one of the watermark.
            open_from = spark.range(1).select(mark.alias("marca")).select(bucket("marca", policy.width)).first()
            is_late = F.col("fecha_hora").isNull()
            if open_from is not None:
                is_late = is_late | (F.col("fecha_hora") < _time(open_from[0]))
            told = {"marca": mark, "dia": F.to_date("fecha_hora"), "consulta": F.lit(consulta), "lote": F.lit(lote).cast("long")}
            dropped = records.filter(is_late).withColumns(told)
            dropped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*WRITTEN).parquet(late)
            states = materialise(bucket_states(records.filter(~is_late), policy), "states")
            if not states.isEmpty():
                _merge(states, policy, target, consulta, lote)

    writer = dispensed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=policy.every)).start()


def read_rollup(spark: SparkSession, target: str) -> DataFrame:
    """The roll-up in the columns of ``rollup_notes``."""
    rows = spark.read.parquet(target)
    mean = F.when(F.col("momentos.n") > 0, F.col("momentos.my"))
    return rows.withColumns({"monto_promedio": mean, "monto_std": sample_deviation(F.col("momentos"))}).drop("momentos", "dia", *WRITTEN)


def refresh_late(spark: SparkSession, dispensed: DataFrame, policy: RefreshPolicy, target: str, late: str, checkpoint: str) -> list[date]:
    """Recompute the days that late rows belong to from the stored records (all of them, late ones too); returns the days.

    Only days that are closed are taken, so the stream adds nothing to them any more; the others wait for a later
    call. What has been brought back is noted beside ``late``, after the days are in place: a call that was stopped is
    repeated whole and gives the same rows. Rows without a time stay in ``late``.
    """
    rows, closed = stored_table(spark, late), watermark(spark, checkpoint, policy)
    if rows is None or closed is None:
        return []
    waiting = rows.filter(F.col("dia") < _time(closed).cast("date")).groupBy(*WRITTEN, "dia").agg(F.count(F.lit(1)).alias("filas"))
    noted = stored_table(spark, f"{late.rstrip('/')}_hechas")
    if noted is not None:
        waiting = waiting.join(noted.select(*WRITTEN, "dia"), [*WRITTEN, "dia"], "left_anti")
    with scratch(spark):
        waiting = materialise(waiting, "late-days")
        days = sorted(r[0] for r in waiting.select("dia").distinct().collect())
        if not days:
            return []
        finish_merge(spark, target, "dia")
        time = F.col("fecha_hora").cast("timestamp_ntz")
        # One range a run of days, so that the scan of the records is cut by time.
        within = reduce(lambda a, b: a | b, [(time >= F.lit(low).cast("timestamp_ntz")) & (time < F.lit(high).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")) for low, high in _runs(days)])
        fresh = bucket_states(dispensed.withColumn("fecha_hora", time).filter(within), policy)
        write_merge(fresh.withColumns({"consulta": F.lit("tardias"), "lote": F.lit(0).cast("long")}), target, "dia")
        waiting.coalesce(1).write.mode("append").parquet(f"{late.rstrip('/')}_hechas")
    return days


def _runs(days: list[date]) -> list[tuple[date, date]]:
    """First and last days of the runs of consecutive days."""
    runs: list[tuple[date, date]] = []
    for day in days:
        if runs and (day - runs[-1][1]).days == 1:
            runs[-1] = (runs[-1][0], day)
        else:
            runs.append((day, day))
    return runs
