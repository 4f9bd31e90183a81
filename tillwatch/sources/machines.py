"""Machine master: CSV export with 26 headings to the dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.functions.text import flag
from tillwatch.schemas import MACHINE_FLAGS, MACHINE_HEADINGS


def read_machines(spark: SparkSession, path: str) -> DataFrame:
    """The export as text columns under its own headings."""
    return spark.read.option("header", True).csv(path)


def rename_machines(raw: DataFrame) -> DataFrame:
    """Known headings renamed, flags normalised; other columns pass through."""
    out = raw.withColumnsRenamed({old: new for old, new in MACHINE_HEADINGS.items() if old in raw.columns})
    return out.withColumns({c: flag(c) for c in MACHINE_FLAGS if c in out.columns})


def replace_machines(spark: SparkSession, path: str, target: str) -> DataFrame:
    rename_machines(read_machines(spark, path)).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
