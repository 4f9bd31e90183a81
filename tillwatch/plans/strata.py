"""Samples of an exact size, dealt over strata in proportion, without sorting or gathering a stratum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.plans.skew import lookup_join
from tillwatch.session import materialise

#: Bits of the hash, and how many of them a round looks at.
BITS, STEP = 60, 12


def row_hash(seed: int, keys: Sequence[str]) -> Column:
    """The first 60 bits of the MD5 of seed and keys, as text joined by bars."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def quotas(sizes: DataFrame, strata: Sequence[str], size: int) -> DataFrame:
    """``sizes`` (strata, n) with ``cupo``: how many of the sample a stratum gets, within one of its share.

    Shares are rounded on their running sum, in the order of the strata, so the quotas add up to ``size`` (or to all rows
    if there are fewer). The running sum is taken within each value of the first stratum column, which has to have few.
    """
    first, rest = strata[0], list(strata[1:])
    outer = sizes.groupBy(first).agg(F.sum("n").alias("_n"))
    outer = outer.withColumn("_desde", F.coalesce(F.sum("_n").over(Window.orderBy(F.col(first).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = outer.select(F.sum("_n")).scalar()
    inside = Window.partitionBy(first).orderBy(*[F.col(c).asc_nulls_first() for c in rest]) if rest else Window.partitionBy(first).orderBy(F.lit(0))
    before = F.col("_desde") + F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sizes.join(outer.select(F.col(first).alias("_primero"), "_desde"), F.col(first).eqNullSafe(F.col("_primero"))).withColumn("_antes", before)
    wanted, exact = F.least(F.lit(size).cast("long"), total), "decimal(38,0)"

    def rounded_share(rows: Column) -> Column:
        return F.floor(rows.cast(exact) * wanted.cast("decimal(18,0)") / total.cast("decimal(18,0)")).cast("long")

    return placed.withColumn("cupo", rounded_share(F.col("_antes") + F.col("n")) - rounded_share(F.col("_antes"))).drop("_primero", "_desde", "_antes")


def stratified_sample(df: DataFrame, strata: Sequence[str], keys: Sequence[str], size: int, seed: int = 42) -> DataFrame:
    """``size`` rows of ``df``, dealt over the strata in proportion; all rows if there are fewer.

    Within a stratum the rows with the smallest hashes of ``keys`` are taken, so the sample does not depend on
    partitioning. The bound of each stratum is found from counts of hash prefixes: a round counts the open prefix
    of every stratum by its next 12 bits, which settles most strata at once and all in five rounds. Rows are never sorted or
    gathered, and a stratum that holds most rows stays in all its tasks. Null is a stratum value like others.
    Rows with equal keys are taken or left together, so the size is exact where keys are unique.
    """
    stratum = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in strata])
    hashed = df.withColumns({"_estrato": stratum, "_hash": row_hash(seed, keys)})
    slim = materialise(hashed.select("_estrato", *strata, "_hash"), "hashes")
    sizes = quotas(slim.groupBy("_estrato", *strata).agg(F.count(F.lit(1)).alias("n")), strata, size)
    # Of an open stratum: the prefix its bound lies in, and how many of that prefix are wanted.
    still = materialise(sizes.select("_estrato", F.lit(0).cast("long").alias("_prefijo"), F.col("cupo").alias("_faltan")).where("_faltan > 0"), "quotas")
    bounds = None
    for shift in range(BITS - STEP, -1, -STEP):
        rows = lookup_join(slim.select("_estrato", "_hash"), still, ["_estrato"], "inner").where(F.shiftright("_hash", shift + STEP) == F.col("_prefijo"))
        bins = rows.groupBy("_estrato", "_faltan", F.shiftright("_hash", shift).alias("_prefijo")).agg(F.count(F.lit(1)).alias("n"))
        so_far = F.sum("n").over(Window.partitionBy("_estrato").orderBy("_prefijo"))
        counted = bins.withColumn("_hasta", so_far).where((F.col("_hasta") - F.col("n") < F.col("_faltan")) & (F.col("_hasta") >= F.col("_faltan")))
        counted = materialise(counted, "bins")
        settled = F.col("_hasta") == F.col("_faltan") if shift else F.lit(True)
        last = F.shiftleft(F.col("_prefijo") + 1, shift) - 1
        found = counted.where(settled).select("_estrato", last.alias("_ultimo"))
        bounds = found if bounds is None else bounds.unionByName(found)
        still = counted.where(~settled).select("_estrato", "_prefijo", (F.col("_faltan") - F.col("_hasta") + F.col("n")).alias("_faltan"))
        if still.isEmpty():
            break
    taken = lookup_join(hashed, materialise(bounds, "bounds"), ["_estrato"], "inner").where(F.col("_hash") <= F.col("_ultimo"))
    return taken.select(*df.columns)
