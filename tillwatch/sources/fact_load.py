"""Loading of the transaction fact: filters, duplicates, renaming, insert-if-absent."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tillwatch.functions.calendar import bucket
from tillwatch.operators.rollup import as_of_or_latest
from tillwatch.schemas import DISPENSING_TYPES, LINEAGE, TRANSACTION_HEADINGS
from tillwatch.sources.key_index import absent_by_index
from tillwatch.sources.tables import stored_table

FACT_KEY = ["id_tlf", "fecha_transaccion"]


def keep_recent(df: DataFrame, months: int, as_of: datetime | None = None, time: str = "fecha_transaccion") -> DataFrame:
    """Rows of the last ``months`` x 30 days before ``as_of`` (default: the newest row)."""
    return df.filter(F.col(time) >= as_of_or_latest(df, time, as_of) - F.expr(f"INTERVAL '{months * 30}' DAY"))


def keep_types(df: DataFrame, types: Sequence[str] = tuple(DISPENSING_TYPES), column: str = "tipo_operacion") -> DataFrame:
    return df.filter(F.col(column).isin(list(types)))


def require_authoriser(df: DataFrame, column: str = "autorizador") -> DataFrame:
    return df.filter(F.col(column).isNotNull() & (F.col(column) != ""))


def drop_duplicates(df: DataFrame, keys: Sequence[str] = tuple(FACT_KEY)) -> DataFrame:
    """First row per key by file name, then by the remaining values (files have no stable row numbers).

    Rows with a null in the key have no identity and all stay. Keys are nearly unique, so the rows are
    shuffled as they are and sorted once, after the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in LINEAGE]
    order = [F.col(c) for c in ("mes_origen", "archivo_origen") if c in df.columns]
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    # Rows without identity are spread by their values instead of meeting in one task.
    spread = F.when(whole, F.xxhash64(*keys)).otherwise(F.xxhash64(*df.columns))
    numbered = df.withColumn("_reparto", spread).repartition("_reparto")
    first = Window.partitionBy("_reparto", *keys).orderBy(*order, *[F.col(c) for c in rest])
    return numbered.withColumn("_n", F.row_number().over(first)).filter((F.col("_n") == 1) | ~whole).drop("_n", "_reparto")


def rename_headings(df: DataFrame) -> DataFrame:
    """Raw headings to column names; columns the fact does not have are dropped."""
    kept = [F.col(f"`{old}`").alias(new) for old, new in TRANSACTION_HEADINGS.items() if old in df.columns]
    return df.select(*kept, *[c for c in LINEAGE if c in df.columns])


def prepare_fact(
    raw: DataFrame,
    months: int | None = 24,
    types: Sequence[str] = tuple(DISPENSING_TYPES),
    as_of: datetime | None = None,
) -> DataFrame:
    """Consolidated extract to fact rows, filtered and without duplicates, with the 15-minute bucket."""
    fact = rename_headings(raw)
    if months is not None:
        fact = keep_recent(fact, months, as_of)
    fact = drop_duplicates(require_authoriser(keep_types(fact, types)))
    return fact.withColumn("fecha_transaccion_15min", bucket("fecha_transaccion"))


def absent_rows(new: DataFrame, existing: DataFrame, keys: Sequence[str] = tuple(FACT_KEY)) -> DataFrame:
    """Rows of ``new`` (one per key) whose key is not in ``existing``.

    Both sides are large and unique per key, so the planner's shuffled anti-join has no hot key; rows with a null in the
    key are in no table.
    """
    return new.join(existing.select(*keys), list(keys), "left_anti")


def insert_if_absent(
    spark: SparkSession, new: DataFrame, target: str, unique: bool = False, times: DataFrame | None = None, by_index: bool = False
) -> dict[str, int]:
    """Append the absent rows to the fact at ``target``, partitioned by day; counts what was inserted and skipped.

    ``unique`` says that ``new`` has one row per key already. ``times`` is a cheap table whose column
    fecha_transaccion spans that of ``new`` (by default ``new`` itself): only days in between are compared. The rows
    are written once; partitions are sized by their bytes, so a day has as many files as it needs. ``by_index`` keeps
    bitmaps of the stored keys beside the table and compares only the rows that they cannot rule out: for a load that
    is small against the days it meets.
    """
    unique_rows = (new if unique else drop_duplicates(new)).withColumn("dia", F.to_date("fecha_transaccion"))
    offered = Observation()
    rows = unique_rows.observe(offered, F.count(F.lit(1)).alias("n"))
    stored = stored_table(spark, target)
    before = 0
    if stored is not None:
        before = stored.count()  # from the footers
    if stored is not None and by_index:
        rows = absent_by_index(spark, rows, target, FACT_KEY)
    elif stored is not None:
        low, high = (new if times is None else times).agg(F.min("fecha_transaccion"), F.max("fecha_transaccion")).first()
        existing = stored.filter(F.col("dia").between(F.lit(low).cast("date"), F.lit(high).cast("date")))
        rows = absent_rows(rows, existing)
    rows.hint("rebalance", "dia").sortWithinPartitions("dia", "cod_terminal", "fecha_transaccion").write.mode("append").partitionBy("dia").parquet(target)
    after = stored_table(spark, target)
    inserted = (after.count() if after is not None else 0) - before
    # A plan that turns out empty is cut short at run time and tells no counts.
    total = offered.get["n"] if inserted else unique_rows.count()
    return {"insertados": inserted, "omitidos": total - inserted}
