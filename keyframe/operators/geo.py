"""Points (key, member, lon, lat): distances, radius and box search, cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EARTH_RADIUS_M, LAT_LIMIT, UNIT_M, haversine


def bounding_box(lon: float, lat: float, half_width_m: float, half_height_m: float) -> tuple[float, float, float, float]:
    """Degrees (west, south, east, north) around a point; reaches the scan as plain comparisons."""
    dlat = math.degrees(half_height_m / EARTH_RADIUS_M)
    top = min(89.999, max(abs(lat - dlat), abs(lat + dlat)))
    dlon = min(180.0, math.degrees(half_width_m / (EARTH_RADIUS_M * math.cos(math.radians(top)))))
    return lon - dlon, lat - dlat, lon + dlon, lat + dlat


def near_box(lon: float, lat: float, half_width_m: float, half_height_m: float) -> Column:
    west, south, east, north = bounding_box(lon, lat, half_width_m * 1.001, half_height_m * 1.001)
    inside = F.col("lat").between(south, north)
    if west < -180 or east > 180:  # over the date line
        return inside & ((F.col("lon") >= (west + 360 if west < -180 else west)) | (F.col("lon") <= (east - 360 if east > 180 else east)))
    return inside & F.col("lon").between(west, east)


def within_radius(points: DataFrame, lon: float, lat: float, radius: float, unit: str = "m") -> DataFrame:
    """GEORADIUS, GEOSEARCH BYRADIUS: points with their distance (in unit)."""
    metres = radius * UNIT_M[unit]
    found = points.where(near_box(lon, lat, metres, metres)).withColumn("_m", haversine(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")))
    return found.where(F.col("_m") <= metres).withColumn("distance", F.col("_m") / UNIT_M[unit]).drop("_m")


def within_box(points: DataFrame, lon: float, lat: float, width: float, height: float, unit: str = "m") -> DataFrame:
    """GEOSEARCH BYBOX: within half the height along the meridian and half the width along the point's parallel."""
    w, h = width * UNIT_M[unit] / 2, height * UNIT_M[unit] / 2
    found = points.where(near_box(lon, lat, w, h))
    along = haversine(F.lit(lon), F.lit(lat), F.lit(lon), F.col("lat"))
    across = haversine(F.lit(lon), F.col("lat"), F.col("lon"), F.col("lat"))
    distance = haversine(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")) / UNIT_M[unit]
    return found.where((along <= h) & (across <= w)).withColumn("distance", distance)


def around_member(points: DataFrame, member, radius: float, unit: str = "m") -> DataFrame:
    """GEORADIUSBYMEMBER: around a member's place, per key."""
    centre = points.where(F.col("member") == F.lit(member)).select("key", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    high = math.degrees(radius * UNIT_M[unit] * 1.001 / EARTH_RADIUS_M)
    near = F.col("lat").between(F.col("_lat") - high, F.col("_lat") + high)
    metres = haversine(F.col("_lon"), F.col("_lat"), F.col("lon"), F.col("lat"))
    found = points.join(centre, "key").where(near).withColumn("distance", metres / UNIT_M[unit])
    return found.where(F.col("distance") <= radius).drop("_lon", "_lat")


def store(points: DataFrame, found: DataFrame, target) -> DataFrame:
    """GEOSEARCHSTORE: the points after target got found and nothing else."""
    kept = found.select(F.lit(target).cast(points.schema["key"].dataType).alias("key"), "member", "lon", "lat")
    return points.where(F.col("key") != F.lit(target)).select("key", "member", "lon", "lat").unionByName(kept)


def store_distances(found: DataFrame, target) -> DataFrame:
    """GEOSEARCHSTORE STOREDIST: a sorted set of the distances."""
    return found.select(F.lit(target).alias("key"), "member", F.col("distance").alias("score"))


def distance_between(points: DataFrame, first, second, unit: str = "m") -> DataFrame:
    """GEODIST of two members, per key."""
    pick = lambda m, c: F.max(F.when(F.col("member") == F.lit(m), F.col(c)))
    both = points.where(F.col("member").isin(first, second)).groupBy("key").agg(*(pick(m, c).alias(f"{c}{i}") for i, m in enumerate((first, second)) for c in ("lon", "lat")))
    return both.select("key", (haversine(F.col("lon0"), F.col("lat0"), F.col("lon1"), F.col("lat1")) / UNIT_M[unit]).alias("distance"))


def closest(found: DataFrame, count: int, tie: str = "member", descending: bool = False) -> DataFrame:
    """COUNT with ASC or DESC."""
    return found.orderBy(F.col("distance").desc() if descending else F.col("distance"), tie).limit(count)


def covering_cells(lon: float, lat: float, radius_m: float) -> list[tuple[int, int]]:
    """At most nine ranges [first, last] of 52-bit cell numbers that cover a circle: the cell of its centre and those around it, of a
    size of at least its radius. They merge where they follow each other."""
    north = min(LAT_LIMIT, abs(lat) + math.degrees(radius_m / EARTH_RADIUS_M))
    across = EARTH_RADIUS_M * math.cos(math.radians(min(north, 89.0)))
    step = 26
    while step > 0 and (math.radians(360.0 / (1 << step)) * across < radius_m or math.radians(2 * LAT_LIMIT / (1 << step)) * EARTH_RADIUS_M < radius_m):
        step -= 1
    n = 1 << step
    x, y = int((lon + 180) / 360 * n), int((lat + LAT_LIMIT) / (2 * LAT_LIMIT) * n)
    found = set()
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            a, b = (min(x, n - 1) + i) % n, y + j
            if 0 <= b < n:
                found.add(sum((b >> k & 1) << 2 * k | (a >> k & 1) << 2 * k + 1 for k in range(step)))
    ranges: list[tuple[int, int]] = []
    for cell in sorted(found):
        low, high = cell << 2 * (26 - step), (cell + 1 << 2 * (26 - step)) - 1
        if ranges and ranges[-1][1] + 1 == low:
            ranges[-1] = (ranges[-1][0], high)
        else:
            ranges.append((low, high))
    return ranges


def within_cells(points: DataFrame, lon: float, lat: float, radius: float, unit: str = "m", cell: str = "cell") -> DataFrame:
    """GEORADIUS over a stored column of cell numbers: its ranges reach the scan, then distances are checked."""
    metres = radius * UNIT_M[unit]
    near = F.lit(False)
    for low, high in covering_cells(lon, lat, metres):
        near = near | F.col(cell).between(low, high)
    found = points.where(near).withColumn("_m", haversine(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")))
    return found.where(F.col("_m") <= metres).withColumn("distance", F.col("_m") / UNIT_M[unit]).drop("_m")
