"""Exact quantiles of whole columns without gathering a column in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to this many rows the built-in exact percentile (one map of values per column) is used.
DIRECT_ROWS = 200_000
BINS = 2048


def _select_ranks(
    values: DataFrame, wanted: dict[str, list[int]], bounds: dict[str, tuple[float, float]]
) -> dict[tuple[str, int], float]:
    """Values at zero-based ranks of each column, by narrowing a range around every rank.

    A round cuts all open ranges into bins and counts them in one partially
    aggregated pass. Bins are bounded by real values, the lowest and highest
    value fall into different bins, so each round shrinks every range; a rank
    is settled when its bin holds one distinct value.
    """
    found: dict[tuple[str, int], float] = {}
    open_ranges = {(c, *bounds[c]): [(rank, rank) for rank in set(ranks)] for c, ranks in wanted.items()}
    while open_ranges:
        settled = [r for r in open_ranges if r[1] == r[2]]
        for column, low, _ in settled:
            found.update({(column, rank): low for rank, _ in open_ranges.pop((column, low, low))})
        ranges = list(open_ranges)
        if not ranges:
            break
        entries = []
        for i, (column, low, high) in enumerate(ranges):
            x = F.col(column)
            share = (x / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)
            bin_number = F.least(F.floor(share * BINS), F.lit(BINS - 1))
            entry = F.struct(F.lit(i).alias("range"), bin_number.alias("bin"), x.alias("x"))
            entries.append(F.when(x.between(low, high), entry))
        bins = (
            values.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
            .groupBy("e.range", "e.bin")
            .agg(F.count(F.lit(1)).alias("n"), F.min("e.x").alias("low"), F.max("e.x").alias("high"))
            .orderBy("range", "bin")
            .collect()  # at most BINS rows per open range
        )
        following: dict[tuple[str, float, float], list[tuple[int, int]]] = {}
        for i, key in enumerate(ranges):
            own = [b for b in bins if b["range"] == i]
            for rank, offset in open_ranges[key]:
                for b in own:
                    if offset < b.n:
                        following.setdefault((key[0], b.low, b.high), []).append((rank, offset))
                        break
                    offset -= b.n
        open_ranges = following
    return found


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], direct_rows: int = DIRECT_ROWS
) -> dict[str, list[float | None]]:
    """Exact quantiles per column with linear interpolation; nulls and NaN are left out."""
    columns = list(columns)
    number = {c: F.col(c).cast("double") for c in columns}
    values = df.select(*[F.when(~F.isnan(x), x).alias(c) for c, x in number.items()])
    if values.count() <= direct_rows:
        row = values.agg(*[F.percentile(c, list(probabilities)).alias(c) for c in columns]).first()
        return {c: row[c] if row[c] is not None else [None] * len(probabilities) for c in columns}
    row = values.agg(
        *[f(c).alias(f"{name}_{c}") for c in columns for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    ).first()
    spots = {c: [p * (row[f"n_{c}"] - 1) for p in probabilities] for c in columns if row[f"n_{c}"]}
    wanted = {c: [r for s in at for r in (math.floor(s), math.ceil(s))] for c, at in spots.items()}
    found = _select_ranks(values, wanted, {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in spots})

    def between(column: str, spot: float) -> float:
        low, high = found[column, math.floor(spot)], found[column, math.ceil(spot)]
        return low + (high - low) * (spot - math.floor(spot))

    return {c: [between(c, s) for s in spots[c]] if c in spots else [None] * len(probabilities) for c in columns}
