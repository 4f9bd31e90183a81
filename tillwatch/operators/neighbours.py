"""Machines within one kilometre: how many, and their mean dispensing.

Neighbour sums inside a radius are taken without listing the pairs of a dense
area. Machines at one coordinate are folded into a site first. Each site meets
the grid cells its circle touches; a cell that lies wholly inside or outside
the circle is settled from its totals, and only cells crossed by the edge are
refined, first into smaller cells and at last into sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.functions.numbers import EARTH_RADIUS_KM, haversine_km
from tillwatch.session import materialise

KM_PER_DEGREE = 111.19492664455873  # great-circle length of one degree on a sphere of 6371 km
RADIUS_KM = 1.0
SELF_KM = 0.001
CELLS_KM = (0.25, 0.025)


def with_coordinates(machines: DataFrame) -> DataFrame:
    """Machines whose latitude and longitude are both valid numbers."""
    lat, lon = F.expr("try_cast(latitud AS DOUBLE)"), F.expr("try_cast(longitud AS DOUBLE)")
    return machines.withColumns({"latitud": lat, "longitud": lon}).filter(
        "latitud IS NOT NULL AND longitud IS NOT NULL AND NOT isnan(latitud) AND NOT isnan(longitud)"
    )


def _row(lat: Column, side: float) -> Column:
    return F.floor(lat * F.lit(KM_PER_DEGREE / side))


def _column(lon: Column, row: Column, side: float) -> Column:
    """Longitude cell; its width in degrees is set by the latitude of the row."""
    shrink = F.greatest(F.cos(F.radians((row + 0.5) * F.lit(side / KM_PER_DEGREE))), F.lit(1e-6))
    return F.floor(lon * shrink * F.lit(KM_PER_DEGREE / side))


def _cell(prefix: str, side: float) -> dict[str, Column]:
    row = _row(F.col("lat"), side)
    return {f"{prefix}_r": row, f"{prefix}_c": _column(F.col("lon"), row, side)}


def _touched(sites: DataFrame, radius: float, side: float, prefix: str) -> DataFrame:
    """One row per site and grid cell its circle may touch."""
    reach = (radius + side) / KM_PER_DEGREE
    lat, lon = F.col("lat"), F.col("lon")
    rows = sites.withColumn(
        f"{prefix}_r", F.explode(F.sequence(_row(lat - reach, side), _row(lat + reach, side)))
    )
    row = F.col(f"{prefix}_r")
    widest = F.cos(F.radians(F.least(F.abs(lat) + 2 * reach, F.lit(89.9))))
    span = F.lit(reach) / widest
    return rows.withColumn(
        f"{prefix}_c", F.explode(F.sequence(_column(lon - span, row, side), _column(lon + span, row, side)))
    )


def _box_distances() -> tuple[Column, Column]:
    """Lower and upper bound of the distance from a site to the box of a cell, up to ``_margin``.

    Flat bounds: a degree of longitude counts at the highest latitude met for
    the lower bound and at the lowest for the upper one.
    """
    lat, lon = F.col("lat"), F.col("lon")
    lo_lat, hi_lat, lo_lon, hi_lon = (F.col(c) for c in ("lo_lat", "hi_lat", "lo_lon", "hi_lon"))
    highest = F.greatest(F.abs(lat), F.abs(lo_lat), F.abs(hi_lat))
    lowest = F.when(lo_lat * hi_lat <= 0, F.lit(0.0)).otherwise(F.least(F.abs(lat), F.abs(lo_lat), F.abs(hi_lat)))

    def flat(north: Column, east: Column, at: Column) -> Column:
        return F.lit(KM_PER_DEGREE) * F.hypot(north, east * F.cos(F.radians(at)))

    zero = F.lit(0.0)
    nearest = flat(
        F.greatest(zero, lo_lat - lat, lat - hi_lat), F.greatest(zero, lo_lon - lon, lon - hi_lon), highest
    )
    farthest = flat(
        F.greatest(F.abs(lat - lo_lat), F.abs(lat - hi_lat)),
        F.greatest(F.abs(lon - lo_lon), F.abs(lon - hi_lon)),
        lowest,
    )
    return nearest, farthest


def _margin(radius: float) -> float:
    """Slack for deciding a whole cell by flat bounds; a cell within it is refined instead."""
    return 1e-6 + radius * (radius / EARTH_RADIUS_KM) ** 2


def _over_date_line(sites: DataFrame, radius: float) -> DataFrame:
    """Sites next to the 180th meridian also appear with a longitude on its other side."""
    widest = F.cos(F.radians(F.least(F.abs("lat"), F.lit(89.9))))
    edge = 180 - F.lit(2 * radius / KM_PER_DEGREE) / widest
    lon = F.col("lon")
    copies = F.array(lon, F.when(lon > edge, lon - 360), F.when(lon < -edge, lon + 360))
    return sites.withColumn("lon", F.explode(F.array_compact(copies)))


def _sums_within(sites: DataFrame, radius: float, cells_km: tuple[float, ...]) -> DataFrame:
    """Per site: number and amount of the machines at most ``radius`` away, itself included."""
    columns = ["lat", "lon", "n", "total"]
    gridded = _over_date_line(sites, radius)
    margin = _margin(radius)
    for level, side in enumerate(cells_km):
        gridded = gridded.withColumns(_cell(f"g{level}", side))
    settled = []
    open_pairs = _touched(sites.select("lat", "lon"), radius, cells_km[0], "g0")
    for level in range(len(cells_km)):
        # Small cells need not nest in large ones, so a cell is named by the cells of all levels.
        key = [f"g{upper}_{part}" for upper in range(level + 1) for part in "rc"]
        parent = key[:-2]
        cells = gridded.groupBy(*key).agg(
            F.sum("n").alias("n"),
            F.sum("total").alias("total"),
            F.min("lat").alias("lo_lat"),
            F.max("lat").alias("hi_lat"),
            F.min("lon").alias("lo_lon"),
            F.max("lon").alias("hi_lon"),
        )
        nearest, farthest = _box_distances()
        # Merged by sorting: sizes are estimated before the circles are unfolded into cells, a hundred rows a site, so a
        # side that looks small enough to be broadcast may not fit the driver.
        met = (
            open_pairs.hint("merge").join(cells, parent or key)
            .withColumn("near", nearest)
            .withColumn("far", farthest)
            .filter(F.col("near") <= radius + margin)
        )
        settled.append(met.filter(F.col("far") <= radius - margin).select(*columns))
        open_pairs = met.filter(F.col("far") > radius - margin).select("lat", "lon", *key)
    others = gridded.select(*key, F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "n", "total")
    distance = haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    settled.append(open_pairs.hint("merge").join(others, key).filter(distance <= radius).select(*columns))
    together = settled[0]
    for part in settled[1:]:
        together = together.unionByName(part)
    return together.groupBy("lat", "lon").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def zone_features(
    profile: DataFrame,
    machines: DataFrame,
    radius_km: float = RADIUS_KM,
    self_km: float = SELF_KM,
    cells_km: tuple[float, ...] = CELLS_KM,
) -> DataFrame:
    """Add place, neighbour count, mean of the neighbours and the ratio to it.

    Neighbours are farther than ``self_km`` and at most ``radius_km`` away. A
    machine without neighbours or coordinates is compared with itself.
    """
    places = with_coordinates(machines).select(
        F.col("codigo").cast("string").alias("cod_cajero"), "latitud", "longitud", "municipio_dane", "departamento"
    )
    # One row per machine; written once because the steps below read it several times.
    located = materialise(profile.join(places, "cod_cajero", "left"), "located")
    here = located.filter("latitud IS NOT NULL")
    sites = here.groupBy(F.col("latitud").alias("lat"), F.col("longitud").alias("lon")).agg(
        F.count("dispensacion_promedio").alias("n"), F.sum("dispensacion_promedio").alias("total")
    )
    sites = materialise(sites, "sites")
    wide = _sums_within(sites, radius_km, cells_km)
    own = _sums_within(sites, self_km, (4 * self_km,))
    around = (
        wide.join(own.select("lat", "lon", F.col("n").alias("n0"), F.col("total").alias("total0")), ["lat", "lon"])
        .withColumn("vecinos", F.col("n") - F.col("n0"))
        .withColumn("media_zona", F.try_divide(F.col("total") - F.col("total0"), F.col("n") - F.col("n0")))
        .select(F.col("lat").alias("latitud"), F.col("lon").alias("longitud"), "vecinos", "media_zona")
    )
    own_mean = F.col("dispensacion_promedio")
    zone_mean = F.coalesce(F.when(F.col("vecinos") > 0, F.col("media_zona")), own_mean)
    return (
        located.join(around, ["latitud", "longitud"], "left")
        .withColumn("cajeros_cercanos_1km", F.coalesce("vecinos", F.lit(0)).cast("int"))
        .withColumn("dispensacion_promedio_zona", zone_mean)
        .withColumn(
            "ratio_vs_zona",
            F.when(
                F.col("dispensacion_promedio_zona") > 0, F.try_divide(own_mean, F.col("dispensacion_promedio_zona"))
            ).otherwise(F.lit(1.0)),
        )
        .drop("vecinos", "media_zona")
    )
