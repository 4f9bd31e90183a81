"""Moments over a sliding frame of preceding rows at a cost per row that does not grow with the frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tillwatch.plans.skew import micros

#: Up to this many rows a plain sliding frame is cheaper.
PLAIN_ROWS = 16


def _moments(y: str, x: str | None, spec: WindowSpec) -> Column:
    """Count, mean and sum of squared deviations of ``y``, with ``x`` also those of ``x`` and the cross sum."""
    n = F.count(y).over(spec)
    parts = [n.alias("n"), F.avg(y).over(spec).alias("my"), (F.var_pop(y).over(spec) * n).alias("syy")]
    if x is not None:
        parts += [
            F.avg(x).over(spec).alias("mx"),
            (F.var_pop(x).over(spec) * n).alias("sxx"),
            (F.covar_pop(x, y).over(spec) * n).alias("sxy"),
        ]
    return F.struct(*parts)


def merged(a: Column, b: Column, with_x: bool = False) -> Column:
    """Moments of two sets of rows together."""
    n = a["n"] + b["n"]
    weight = a["n"] * b["n"] / n
    dy = b["my"] - a["my"]
    parts = [
        n.alias("n"),
        (a["my"] + dy * b["n"] / n).alias("my"),
        (a["syy"] + b["syy"] + dy * dy * weight).alias("syy"),
    ]
    if with_x:
        dx = b["mx"] - a["mx"]
        parts += [
            (a["mx"] + dx * b["n"] / n).alias("mx"),
            (a["sxx"] + b["sxx"] + dx * dx * weight).alias("sxx"),
            (a["sxy"] + b["sxy"] + dx * dy * weight).alias("sxy"),
        ]
    return F.when(a.isNull() | (a["n"] == 0), b).when(b.isNull() | (b["n"] == 0), a).otherwise(F.struct(*parts))


def with_preceding_moments(
    df: DataFrame, key: str, order: Sequence[str], y: str, rows: int, out: str, x: str | None = None
) -> DataFrame:
    """Add the moments of up to ``rows`` rows before each row of its key, as the struct ``out``.

    The rows of a key are cut into blocks as long as the frame. A frame is then
    the end of one block and the start of the next, so running moments taken
    from both ends of every block give each frame by one merge.
    """
    by_key = Window.partitionBy(key).orderBy(*order)
    if rows <= PLAIN_ROWS:
        return df.withColumn(out, _moments(y, x, by_key.rowsBetween(-rows, -1)))
    block = Window.partitionBy(key, "_block")
    running = (Window.unboundedPreceding, Window.currentRow)
    in_blocks = Window.partitionBy(key).orderBy("_block", *order)  # the order of by_key, sorted like the block starts
    return (
        df.withColumn("_row", F.row_number().over(by_key) - 1)
        .withColumn("_block", F.floor(F.col("_row") / rows))
        .withColumn("_end", _moments(y, x, block.orderBy(*[F.desc(c) for c in order]).rowsBetween(*running)))
        .withColumn("_start", _moments(y, x, block.orderBy(*order).rowsBetween(*running)))
        .withColumn("_end", F.lag("_end", rows).over(in_blocks))
        .withColumn("_start", F.lag("_start", 1).over(in_blocks))
        .withColumn(
            out,
            F.when(F.col("_end").isNull(), F.col("_start"))
            .when(F.col("_row") % rows == 0, F.col("_end"))  # the frame is exactly one block
            .otherwise(merged(F.col("_end"), F.col("_start"), x is not None)),
        )
        .drop("_row", "_block", "_end", "_start")
    )


def with_moments_since(
    df: DataFrame, keys: Sequence[str], time: str, y: str, seconds: int, out: str, x: str | None = None
) -> DataFrame:
    """Add the moments of the rows less than or exactly ``seconds`` before each row of its keys, as the struct ``out``.

    Rows of the same time are not before each other; without a time there is nothing before. Time is
    cut into blocks as long as the frame, by the clock, so a frame is the end of one block and the start of the next: the
    start is a running sum, and the end, summed from behind, is handed ``seconds`` later to the rows that need it.
    The cost of a row does not grow with the frame, and a key with many rows is spread over its blocks.
    """
    span = seconds * 1_000_000
    block = Window.partitionBy(*keys, "_block")
    early = block.orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    late = block.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = df.withColumn("_at", micros(time)).withColumn("_block", F.floor(F.col("_at") / span))
    summed = placed.withColumn("_start", _moments(y, x, early)).withColumn("_end", _moments(y, x, late))
    both = summed.withColumn("_handed", F.explode(F.array(F.lit(False), F.lit(True)))).where(~F.col("_handed") | F.col("_at").isNotNull())
    handed = F.col("_handed")
    moved = both.select(
        *[c if c in keys else F.when(~handed, F.col(c)).alias(c) for c in df.columns],
        (F.col("_at") + F.when(handed, span).otherwise(0)).alias("_at"),
        (F.col("_block") + F.when(handed, 1).otherwise(0)).alias("_block"),
        "_handed",
        F.when(~handed, F.col("_start")).alias("_start"),
        F.when(handed, F.col("_end")).alias("_end"),
    )
    from_behind = block.orderBy(F.desc("_at"), F.desc("_handed")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = moved.withColumn("_end", F.last("_end", ignorenulls=True).over(from_behind)).where(~handed)
    moments = F.when(F.col("_at").isNotNull(), merged(F.col("_end"), F.col("_start"), x is not None))
    return found.withColumn(out, moments).drop("_at", "_block", "_handed", "_start", "_end")


def including_current(moments: Column, y: str, x: str | None = None) -> Column:
    """Moments of the preceding rows together with the current row."""
    zero = F.lit(0.0)
    own = [F.lit(1).cast("bigint").alias("n"), F.col(y).cast("double").alias("my"), zero.alias("syy")]
    if x is not None:
        own += [F.col(x).cast("double").alias("mx"), zero.alias("sxx"), zero.alias("sxy")]
    return merged(moments, F.struct(*own), x is not None)


def sample_deviation(moments: Column) -> Column:
    """Standard deviation with n - 1; null below two rows."""
    return F.when(moments["n"] > 1, F.sqrt(moments["syy"] / (moments["n"] - 1)))


def slope(moments: Column) -> Column:
    """Least-squares slope of y on x; null below two rows or without spread in x."""
    return F.when((moments["n"] > 1) & (moments["sxx"] > 0), moments["sxy"] / moments["sxx"])
