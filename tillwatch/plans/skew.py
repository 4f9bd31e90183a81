"""Joins and ordered windows that hold up when one key owns a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.session import materialise

#: Row bound under which a lookup side is broadcast (a few tens of MB for the dimensions used here).
BROADCAST_ROWS = 200_000
SALTS = 32
#: Rows that a lookup side may be repeated to.
SALTED_ROWS = 2_000_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows. The count reads no columns (of files only the footers)."""
    return df.count() <= max_rows


def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
    derived: bool = False,
) -> DataFrame:
    """Join a large table to a table with one row per key.

    A side proven small is broadcast, so the large table is not shuffled.
    Otherwise the large table is salted by a hash of its rows and the other
    side repeated per salt, so a hot key is spread over ``salts`` tasks, fewer where the
    copies would be more than ``SALTED_ROWS``. A larger side is not repeated: both are shuffled
    as they are, and the adaptive skew join that ``prepare`` turns on deals out the rows of a hot key.
    Spark's own estimate, which counts neither copies nor what a file unfolds to, does not make a broadcast of either.
    ``derived`` says that the small side is computed from a large table; it is
    then written once instead of being computed for the check and the join.
    """
    on = list(on)
    if derived:
        dim = materialise(dim, "lookup")
    n = dim.count()
    if n <= max_rows:
        return fact.join(F.broadcast(dim), on, how)
    salts = min(salts, SALTED_ROWS // n)
    if salts <= 1:
        return fact.join(dim.hint("merge"), on, how)
    salted_fact = fact.withColumn("_salt", F.pmod(F.xxhash64(*fact.columns), F.lit(salts)).cast("int"))
    salted_dim = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_fact.join(salted_dim.hint("merge"), [*on, "_salt"], how).drop("_salt")


def anti_join(
    fact: DataFrame, dim: DataFrame, on: Sequence[str], max_rows: int = BROADCAST_ROWS, derived: bool = False
) -> DataFrame:
    """Rows of ``fact`` whose key is absent from ``dim``."""
    return lookup_join(fact, dim.select(*on), on, "left_anti", max_rows, derived=derived)


#: Slices of a sliced window are made finer until the largest has at most this many rows.
SLICE_ROWS = 1_000_000
SLICE_UNITS = ("month", "day", "hour", "minute", "second")


def _slice(ts: str, unit: str) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


#: Units that a table of hours can be folded to.
COARSE_UNITS = SLICE_UNITS[:3]


def hourly(df: DataFrame, keys: Sequence[str], ts: str, **more: Column) -> DataFrame:
    """Rows (_n), last time (_last) and further aggregates per key and hour, written once.

    One pass over a large table from which slices, carries and statistics per key are taken.
    """
    totals = df.groupBy(*keys, _slice(ts, "hour").alias("_hour")).agg(
        F.count(F.lit(1)).alias("_n"), F.max(ts).alias("_last"), *[c.alias(n) for n, c in more.items()]
    )
    return materialise(totals, "hourly")


def slice_unit(df: DataFrame, keys: Sequence[str], ts: str, hours: DataFrame, max_rows: int = SLICE_ROWS) -> str:
    """The coarsest time unit in which no key has more than ``max_rows`` rows.

    Units down to the hour are tried together on the table ``hours``; only if an hour is too large the table itself is counted.
    """

    def largest(rows: DataFrame, unit: str, time: str, n: Column) -> DataFrame:
        return rows.groupBy(*keys, _slice(time, unit)).agg(n.alias("n")).agg(F.lit(unit).alias("unit"), F.max("n").alias("n"))

    tried = reduce(DataFrame.unionAll, [largest(hours, u, "_hour", F.sum("_n")) for u in COARSE_UNITS]).collect()
    sizes = {r.unit: r.n or 0 for r in tried}
    for unit in SLICE_UNITS[:-1]:
        if unit not in sizes:
            sizes[unit] = largest(df, unit, ts, F.count(F.lit(1))).first().n or 0
        if sizes[unit] <= max_rows:
            return unit
    return SLICE_UNITS[-1]


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: Sequence[str],
    out: str,
    unit: str | None = None,
    hours: DataFrame | None = None,
) -> DataFrame:
    """Add the time of the previous row of the same key.

    The window is cut into time slices, so a hot key is many small groups. The
    first row of a slice takes the last time of the key's preceding slice from
    a table with one row per key and slice. Without a ``unit`` the slices are
    as coarse as the hottest key allows. ``hours`` is ``hourly`` of ``df`` if there is one already.
    """
    keys = list(keys)
    hours = hourly(df, keys, ts) if hours is None else hours
    unit = unit or slice_unit(df, keys, ts, hours)
    sliced = df.withColumn("_slice", _slice(ts, unit))
    last = _per_slice(sliced, hours, keys, unit, F.max("_last") if unit in COARSE_UNITS else F.max(ts))
    carry = last.select(
        *keys, "_slice", F.lag("_value").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_carry")
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(ts, *tie)
    return (
        sliced.join(carry, [*keys, "_slice"], "left")
        .withColumn(out, F.coalesce(F.lag(ts).over(inside), F.col("_carry")))
        .drop("_slice", "_carry")
    )


def _per_slice(sliced: DataFrame, hours: DataFrame, keys: list[str], unit: str, value: Column) -> DataFrame:
    """One value per key and slice, from the table of hours where slices are hours at least."""
    rows = hours.withColumn("_slice", _slice("_hour", unit)) if unit in COARSE_UNITS else sliced
    return rows.groupBy(*keys, "_slice").agg(value.alias("_value"))


def micros(ts: str | Column) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def with_lookback(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    seconds: int,
    aggregates: dict[str, Column],
    shorter: dict[str, int] | None = None,
) -> DataFrame:
    """Aggregate over the rows of the same key in the ``seconds`` up to each row, both ends included.

    ``shorter`` gives single aggregates fewer seconds; all share one shuffle and one sort. Rows without a time are dropped.

    Time is cut into slices as long as the look-back. Every row is also handed
    to the next slice as context only, so each slice is complete on its own and
    a hot key never becomes one group.
    """
    span = seconds * 1_000_000
    timed = df.withColumn("_us", micros(ts)).withColumn("_own", F.floor(F.col("_us") / F.lit(span)))
    spread = timed.withColumn("_slice", F.explode(F.array("_own", F.col("_own") + 1)))
    for name, expression in aggregates.items():
        back = (shorter or {}).get(name, seconds) * 1_000_000
        if back > span:
            raise ValueError(f"{name} looks back farther than {seconds} s")
        spread = spread.withColumn(name, expression.over(Window.partitionBy(*keys, "_slice").orderBy("_us").rangeBetween(-back, 0)))
    return spread.filter("_slice = _own").drop("_us", "_own", "_slice")


def with_running_count(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: Sequence[str],
    condition: Column,
    out: str,
    unit: str | None = None,
) -> DataFrame:
    """Running count of ``condition`` per key in time order, by slices plus the total of earlier slices."""
    keys = list(keys)
    hit = F.when(condition, 1).otherwise(0)
    hours = hourly(df, keys, ts, _hits=F.sum(hit))
    unit = unit or slice_unit(df, keys, ts, hours)
    sliced = df.withColumn("_slice", _slice(ts, unit)).withColumn("_hit", hit)
    totals = _per_slice(sliced, hours, keys, unit, F.sum("_hits") if unit in COARSE_UNITS else F.sum("_hit"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_slice", F.coalesce(F.sum("_value").over(earlier), F.lit(0)).alias("_before"))
    inside = (
        Window.partitionBy(*keys, "_slice").orderBy(ts, *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        sliced.join(carry, [*keys, "_slice"], "left")
        .withColumn(out, F.sum("_hit").over(inside) + F.col("_before"))
        .drop("_slice", "_hit", "_before")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the smallest by ``order``.

    An aggregate, not a window: copies are folded before the shuffle, so a key that owns many copies costs
    one row per task. It sorts before and after the shuffle; where keys are nearly unique, see
    ``fact_load.drop_duplicates``.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    picked = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])
