"""Named Parquet tables under a base path, and keyed merges into them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.plans.skew import first_per_key
from tillwatch.schemas import ALERT_KEY
from tillwatch.session import materialise


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where nothing has been written yet."""
    if not exists(spark, path):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_table(spark: SparkSession, base: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A table, read lazily; filters and column choices reach the files."""
    df = spark.read.parquet(f"{base.rstrip('/')}/{name}")
    return df.select(*columns) if columns else df


def append_table(df: DataFrame, base: str, name: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(f"{base.rstrip('/')}/{name}")


def replace_table(df: DataFrame, base: str, name: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{base.rstrip('/')}/{name}")


def switch_table(df: DataFrame, base: str, name: str) -> None:
    """Replace a table by rows that may be made from it: written beside it, complete, then renamed into its place."""
    target = f"{base.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(_pending(target))
    finish_switch(df.sparkSession, base, name)


def finish_switch(spark: SparkSession, base: str, name: str) -> None:
    """Put a complete table that lies beside ``name`` in its place; an incomplete one is removed.

    The old table goes only when the new one is complete, so at any time one of them is whole.
    """
    target = f"{base.rstrip('/')}/{name}"
    pending = _pending(target)
    if not exists(spark, pending):
        return
    if exists(spark, f"{pending}/_SUCCESS"):
        remove(spark, target)
        at = spark._jvm.org.apache.hadoop.fs.Path(pending)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).rename(at, spark._jvm.org.apache.hadoop.fs.Path(target)):
            raise OSError(f"{pending} could not be renamed")
    else:
        remove(spark, pending)


# What an alert that exists already takes over from a newer one.
ALERT_UPDATES = ["severidad", "score_anomalia", "desviacion_std", "descripcion", "razones", "fecha_deteccion"]
ALERT_MERGE_KEY = ALERT_KEY

# What a machine's stored summary takes over; weekday means stay as first written.
SUMMARY_UPDATES = [
    "dispensacion_promedio",
    "dispensacion_std",
    "dispensacion_max",
    "dispensacion_min",
    "disp_promedio_madrugada",
    "disp_promedio_manana",
    "disp_promedio_tarde",
    "disp_promedio_noche",
    "total_transacciones",
    "fecha_ultimo_registro",
    "fecha_calculo",
]


def merge_rows(current: DataFrame, incoming: DataFrame, keys: Sequence[str], updates: Sequence[str]) -> DataFrame:
    """Upsert: new keys are added whole, known keys take over the ``updates`` columns only.

    Both sides hold one row per key, so the full outer join has no hot key.
    """
    keys = list(keys)
    old = current.select(*keys, F.struct(*[c for c in current.columns if c not in keys]).alias("_old"))
    new = incoming.select(*keys, F.struct(*[c for c in current.columns if c not in keys]).alias("_new"))
    both = old.join(new, keys, "full_outer")

    def merged(c: str):
        if c in updates:
            value = F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col("_old")[c])
        else:
            value = F.when(F.col("_old").isNotNull(), F.col("_old")[c]).otherwise(F.col("_new")[c])
        return value.alias(c)

    return both.select(*[F.col(c) if c in keys else merged(c) for c in current.columns])


def upsert_partitions(
    spark: SparkSession,
    incoming: DataFrame,
    target: str,
    keys: Sequence[str],
    updates: Sequence[str],
    partition: str,
) -> None:
    """Merge into a table partitioned by ``partition`` (a function of the key), rewriting only the partitions met.

    The merged partitions are written beside the table first. If the run stops while they replace the
    old ones, the next merge (or ``finish_merge``) puts them in place before it reads, so nothing is lost and a replay
    gives the same table.
    """
    finish_merge(spark, target, partition)
    stored = stored_table(spark, target)
    if stored is not None:
        met = [r[0] for r in incoming.select(partition).distinct().collect()]  # days of one load
        current = stored.filter(F.col(partition).isin(met)).select(*incoming.columns)
        incoming = merge_rows(current, incoming, [*keys, partition], updates)
    write_merge(incoming, target, partition)


def write_merge(merged: DataFrame, target: str, partition: str) -> None:
    """Put whole partitions in the place of those of the table, written beside it first."""
    merged.write.mode("overwrite").partitionBy(partition).parquet(_pending(target))
    finish_merge(merged.sparkSession, target, partition)


def _pending(target: str) -> str:
    return f"{target.rstrip('/')}_pendiente"


def finish_merge(spark: SparkSession, target: str, partition: str) -> None:
    """Put complete merged partitions that lie beside the table in place, and remove them."""
    pending = _pending(target)
    if not exists(spark, pending):
        return
    if exists(spark, f"{pending}/_SUCCESS"):
        merged = stored_table(spark, pending)
        if merged is not None:
            _replace_partitions(merged, target, partition)
    remove(spark, pending)


def _replace_partitions(merged: DataFrame, target: str, partition: str) -> None:
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(target)


def upsert_alerts(spark: SparkSession, alerts: DataFrame, target: str) -> None:
    """Merge alerts on (machine, time); amounts of a known alert stay as first written."""
    unique = first_per_key(alerts, ALERT_MERGE_KEY, [-F.col("score_anomalia"), F.col("tipo_anomalia")])
    dated = materialise(unique.withColumn("dia", F.to_date("fecha_hora")), "alerts")  # read three times below
    updates = [*ALERT_UPDATES, "lote"] if "lote" in alerts.columns else ALERT_UPDATES
    upsert_partitions(spark, dated, target, ALERT_MERGE_KEY, updates, "dia")
