"""15-minute files as they arrive: parse, score, merge the alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillwatch.operators.isolation_forest import Forest
from tillwatch.operators.rules import file_alerts, file_totals, score_totals, with_history
from tillwatch.session import materialise, scratch
from tillwatch.sources.quarter_files import parse_lines, with_file, with_position
from tillwatch.sources.tables import upsert_alerts


def score_machines(profile: DataFrame, forest: Forest) -> DataFrame:
    """Profile with the raw model score. The model sees only history, so one pass serves every file."""
    return forest.transform(profile, fill_zero=True).drop("es_anomalia", "score_anomalia")


def detect_in_files(
    lines: DataFrame,
    scored_profile: DataFrame,
    raw_model_score: Column | None = None,
    min_score: float = 0.5,
    model_range: tuple[float, float] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Alerts of the given file lines, and the totals of machines without history."""
    totals = materialise(file_totals(parse_lines(lines)), "totals")
    known, unknown = with_history(totals, scored_profile)
    raw = F.col("score_modelo") if raw_model_score is None else raw_model_score
    return file_alerts(score_totals(known, raw, min_score, model_range)), unknown


def watch_files(
    spark: SparkSession,
    folder: str,
    scored_profile: DataFrame | Callable[[], DataFrame],
    target: str,
    checkpoint: str,
    files_per_trigger: int = 100,
    once: bool = False,
    model_range: tuple[float, float] | None = None,
    on_unknown: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Process new files of ``folder`` every 15 minutes and merge their alerts into the table at ``target``.

    A function as ``scored_profile`` is asked for every batch, so a long run uses the newest profile. Work folders of a batch
    are removed once its alerts are merged.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            profile = scored_profile() if callable(scored_profile) else scored_profile
            lines = materialise(with_position(batch), "lines")
            alerts, unknown = detect_in_files(lines, profile, model_range=model_range)
            upsert_alerts(batch.sparkSession, alerts.withColumn("lote", F.lit(batch_id)), target)
            if on_unknown is not None:
                on_unknown(unknown)

    stream = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    writer = with_file(stream).writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="15 minutes")
    return writer.start()


def alerts_of_batch(alerts: DataFrame, batch: int | None = None) -> DataFrame:
    """Alerts written by one batch (default: the newest)."""
    wanted = F.lit(batch) if batch is not None else alerts.select(F.max("lote")).scalar()
    return alerts.filter(F.col("lote") == wanted)
