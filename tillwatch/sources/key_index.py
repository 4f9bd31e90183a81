"""Bloom bitmaps of the keys of a stored table by day: which rows of a load may be there already.

A bitmap is made of 64-bit words, of which only those with a key are rows. A key sets three bits of one word, so its test
is one equality join, and the bitmaps of two sets of files add up by ``bit_or``. A bitmap says "surely not" or
"perhaps": it saves the comparison, never decides that a row is stored.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.session import materialise
from tillwatch.sources.tables import stored_table

#: A day has 2 ** WORD_BITS words: 64 M words, enough for some 500 M keys with few false hits. More keys give more of them.
WORD_BITS = 26
DAY = "dia"


def _known(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def placed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the number of their word (palabra) and its bits; rows with a null in the key are spread by their values."""
    digest = F.when(_known(keys), F.xxhash64(*keys)).otherwise(F.xxhash64(*rows.columns))
    with_digest = rows.withColumn("_huella", digest)
    bits = [F.expr(f"shiftleft(1L, cast(shiftright(_huella, {6 * i}) & 63 AS int))") for i in range(3)]
    word = F.shiftrightunsigned("_huella", 64 - WORD_BITS)
    return with_digest.withColumns({"palabra": word, "bits": reduce(lambda a, b: a.bitwiseOR(b), bits)}).drop("_huella")


def key_bits(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The bitmap of ``rows``: day, palabra, bits. Copies of a key meet in partial aggregates; rows without key are in none."""
    return placed(rows.select(DAY, *keys).filter(_known(keys)), keys).groupBy(DAY, "palabra").agg(F.bit_or("bits").alias("bits"))


def _paths(target: str) -> tuple[str, str]:
    base = target.rstrip("/")
    return f"{base}_llaves", f"{base}_llaves_archivos"


def index_keys(spark: SparkSession, target: str, keys: Sequence[str]) -> int:
    """Bring the bitmaps beside ``target`` up to date; returns how many files were read for it.

    Only files that no finished run has indexed are read, whoever wrote them. The list of a run's files is written last, as
    one file, so a run that was stopped counts for nothing. Files that are gone leave bits behind: false hits only.
    """
    stored = stored_table(spark, target)
    if stored is None:
        return 0
    bitmaps, lists = _paths(target)
    done = stored_table(spark, lists)
    known = set() if done is None else {r[0] for r in done.select("archivo").collect()}  # names of files, as the driver lists them for any scan
    fresh = [p for p in stored.inputFiles() if p not in known]
    if not fresh:
        return 0
    run = uuid.uuid4().hex
    rows = spark.read.schema(stored.schema).option("basePath", target).parquet(*[unquote(p) for p in fresh])
    key_bits(rows, keys).withColumn("carga", F.lit(run)).hint("rebalance", DAY).write.mode("append").partitionBy("carga", DAY).parquet(bitmaps)
    spark.createDataFrame([(p, run) for p in fresh], "archivo string, carga string").coalesce(1).write.mode("append").parquet(lists)
    return len(fresh)


def stored_bits(spark: SparkSession, target: str) -> DataFrame | None:
    """The bitmaps of all finished runs together; None without any."""
    bitmaps, lists = _paths(target)
    done, bits = stored_table(spark, lists), stored_table(spark, bitmaps)
    if done is None or bits is None:
        return None
    runs = [r[0] for r in done.select("carga").distinct().collect()]  # one a load
    return bits.filter(F.col("carga").isin(runs)).withColumn(DAY, F.col(DAY).cast("date")).groupBy(DAY, "palabra").agg(F.bit_or("bits").alias("guardados"))


def with_possible(rows: DataFrame, bits: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """``rows`` with ``posible``: false for what is surely not stored. Keys are spread by hash, so no word is hot."""
    if bits is None:
        return rows.withColumn("posible", F.lit(False))
    hit = F.coalesce(F.col("guardados").bitwiseAND(F.col("bits")) == F.col("bits"), F.lit(False)) & _known(keys)
    return placed(rows, keys).join(bits, [DAY, "palabra"], "left").withColumn("posible", hit).drop("palabra", "bits", "guardados")


def stored_candidates(stored: DataFrame, possible: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the stored rows that share day and word with a row of ``possible``: what an exact comparison has to shuffle.

    Other days are not read; the words of a load are a small side, which the planner broadcasts where its size allows.
    """
    days = [r[0] for r in possible.select(DAY).distinct().collect()]  # days of one load
    words = placed(possible.select(DAY, *keys), keys).select(DAY, "palabra").distinct()
    there = placed(stored.filter(F.col(DAY).isin(days)).select(DAY, *keys).filter(_known(keys)), keys)
    return there.join(words, [DAY, "palabra"], "left_semi").select(*keys)


def absent_by_index(spark: SparkSession, rows: DataFrame, target: str, keys: Sequence[str]) -> DataFrame:
    """Rows (one per key, with their day) whose key is not in the table at ``target``: exact, but only possible hits are compared.

    Rows with a null in the key are in no table and all stay.
    """
    stored = stored_table(spark, target)
    if stored is None:
        return rows
    index_keys(spark, target, keys)
    marked = materialise(with_possible(rows, stored_bits(spark, target), keys), "possible-keys")  # read three times below
    possible = marked.filter("posible")
    absent = possible.join(stored_candidates(stored, possible, keys), list(keys), "left_anti")
    return marked.filter(~F.col("posible")).unionByName(absent).drop("posible")
