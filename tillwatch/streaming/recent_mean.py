"""The recent mean of each machine as keyed state, and the rule of drastic changes on it.

Files become totals per file and machine, totals become a stream of their own, and for each total the state of
its machine gives the mean of the totals just before it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tillwatch.operators.rules import file_alerts, file_totals, score_totals, with_history
from tillwatch.plans.skew import micros
from tillwatch.session import STATE_STORE, materialise, scratch
from tillwatch.sources.quarter_files import parse_lines, with_file, with_position
from tillwatch.sources.tables import upsert_alerts

TOTALS = "archivo_origen string, cod_cajero string, monto_dispensado double, fecha_hora timestamp_ntz"
#: So many earlier totals make the mean, none older than so many seconds; a machine silent for so many is forgotten.
BUCKETS, MAX_AGE, FORGET = 4, 24 * 3600, 7 * 24 * 3600
#: Totals later than this are left out.
LATENESS = "1 day"
#: Totals kept per machine, as a multiple of those that make a mean: how many files late a file may come.
KEPT = 4
MEAN = Row("archivo_origen", "cod_cajero", "monto_dispensado", "instante", "promedio_reciente")


def _number(value: float | None) -> float | None:
    """Null for what is not a number."""
    return None if value is None or value != value else value


class RecentMean(StatefulProcessor):
    """State: the newest totals of a machine by their time. A total of a time that is there already replaces it.

    A timer stands at the time at which the machine will have been silent for too long; then its state goes. Most
    machines bring few totals a batch, so they are handled as plain rows: a table for each would cost far more than its rows.
    """

    def __init__(self, buckets: int, max_age: int, forget: int) -> None:
        self.buckets, self.max_age, self.forget = buckets, max_age * 1_000_000, forget * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getListState("newest", "instante bigint, monto double")

    def ends(self, newest: int) -> int:
        return newest // 1000 + self.forget

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = dict(self.newest.get())
        times, found = sorted(held), []
        before_ends = self.ends(times[-1]) if times else None
        for row in sorted(rows, key=lambda row: (row.instante, row.archivo_origen)):
            at, amount = row.instante, row.monto_dispensado
            place = bisect_left(times, at)
            amounts = [held[t] for t in times[max(0, place - self.buckets) : place] if t >= at - self.max_age]
            mean = sum(amounts) / len(amounts) if amounts else None
            if at not in held:
                times.insert(place, at)
            held[at] = amount
            if len(times) > KEPT * self.buckets:
                del held[times.pop(0)]
            found.append(MEAN(row.archivo_origen, row.cod_cajero, _number(amount), at, _number(mean)))
        self.newest.put([(t, held[t]) for t in times])
        if before_ends != self.ends(times[-1]):
            if before_ends is not None:
                self.handle.deleteTimer(before_ends)
            self.handle.registerTimer(self.ends(times[-1]))
        return iter(found)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.newest.clear()
        return iter(())


def recent_means(totals: DataFrame, buckets: int = BUCKETS, max_age: int = MAX_AGE, forget: int = FORGET, lateness: str = LATENESS) -> DataFrame:
    """Stream of totals (archivo_origen, cod_cajero, monto_dispensado, fecha_hora) with promedio_reciente.

    The mean is that of the last ``buckets`` totals of the machine before this one's time, none older than ``max_age``
    seconds, as known when it arrives; null without any. A late total gets the mean of those before it, as long as
    they are among the ``KEPT`` times ``buckets`` newest. Totals without machine, time or amount are left out.
    """
    totals.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    known = totals.dropna(subset=["cod_cajero", "fecha_hora", "monto_dispensado"])
    rows = known.withColumn("fecha_hora", F.col("fecha_hora").cast("timestamp")).withWatermark("fecha_hora", lateness)
    rows = rows.select(F.coalesce("archivo_origen", F.lit("")).alias("archivo_origen"), "cod_cajero", "monto_dispensado", "fecha_hora", micros("fecha_hora").alias("instante"))
    found = rows.groupBy("cod_cajero").transformWithState(
        RecentMean(buckets, max_age, forget),
        "archivo_origen string, cod_cajero string, monto_dispensado double, instante bigint, promedio_reciente double",
        "Update",
        "EventTime",
    )
    return found.withColumn("fecha_hora", F.timestamp_micros("instante").cast("timestamp_ntz")).drop("instante")


def watch_totals(spark: SparkSession, folder: str, target: str, checkpoint: str, files_per_trigger: int = 100, once: bool = False) -> StreamingQuery:
    """Write the totals of new 15-minute files to the table at ``target``, a folder (``lote``) for every batch.

    A batch that is repeated replaces its folder.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            lines = materialise(with_position(batch), "lines")
            file_totals(parse_lines(lines)).write.mode("overwrite").parquet(f"{target}/lote={batch_id}")

    stream = with_file(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder))
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="15 minutes")
    return writer.start()


def totals_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The table ``watch_totals`` writes, as a stream."""
    return spark.readStream.schema(f"{TOTALS}, lote long").option("maxFilesPerTrigger", files_per_trigger).parquet(path).drop("lote")


def maintain_recent_means(totals: DataFrame, target: str, checkpoint: str, once: bool = False, **policy: int | str) -> StreamingQuery:
    """Append every total with its recent mean to the table at ``target``, by day."""
    rows = recent_means(totals, **policy).withColumn("dia", F.to_date("fecha_hora"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        out = batch.withColumn("lote", F.lit(batch_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lote", "dia").parquet(target)

    writer = rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="15 minutes")).start()


def watch_recent(
    totals: DataFrame,
    scored_profile: DataFrame | Callable[[], DataFrame],
    target: str,
    checkpoint: str,
    min_score: float = 0.5,
    model_range: tuple[float, float] | None = None,
    once: bool = False,
    **policy: int | str,
) -> StreamingQuery:
    """Alerts of arriving totals, with the live recent mean in the rule of drastic changes.

    Without earlier totals the rule compares with the machine's history, as it does in ``watch_files``.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            profile = scored_profile() if callable(scored_profile) else scored_profile
            known, _ = with_history(materialise(batch, "totals"), profile)
            alerts = file_alerts(score_totals(known, F.col("score_modelo"), min_score, model_range, F.col("promedio_reciente")))
            upsert_alerts(batch.sparkSession, alerts.withColumn("lote", F.lit(batch_id)), target)

    writer = recent_means(totals, **policy).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="15 minutes")).start()
