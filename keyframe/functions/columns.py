"""Scalar expressions that the operators share. All are built-in functions on columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """A value as a double, null if it isn't one."""
    return c.try_cast("double")


def safe_div(a: Column, b: Column) -> Column:
    """a / b, 0 where that is undefined."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def glob_to_regex(pattern: str) -> str:
    """An anchored regular expression of a glob: * ? [abc] [^a] [a-z] and backslash escapes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            out.append(pattern[i : end + 1].replace("\\", "\\\\"))
            i = end
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        i += 1
    return f"(?s)^{''.join(out)}$"


def byte_range(value: Column, start: int, end: int) -> Column:
    """Bytes start .. end of value, both included; negative places count from the back. A cut character leaves its bytes."""
    data = value.cast("binary")
    n = F.octet_length(value)
    at = lambda i: F.lit(i) if i >= 0 else F.greatest(n + i, F.lit(0))
    first, last = at(start), F.least(at(end) if end >= 0 else n + end, n - 1)
    return F.when((first > last) | (n == 0), F.lit("")).otherwise(F.substring(data, first + 1, last - first + 1).cast("string"))


def overwrite(value: Column, offset: int, part: str) -> Column:
    """value with the bytes of part written at byte offset (0-based), padded with NUL up to it."""
    new = F.lit(part).cast("binary")
    size = len(part.encode())
    padded = F.rpad(value.cast("binary"), F.greatest(F.octet_length(value), F.lit(offset)), F.lit("\0").cast("binary"))
    return F.concat(F.substring(padded, 1, offset), new, F.substring(padded, F.lit(offset + size + 1), F.octet_length(padded))).cast("string")


# ------------------------------------------------------------------- vectors


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def inner_product_distance(a: Column, b: Column) -> Column:
    return -dot(a, b)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, not below 0; 1 if a vector is zero."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, 1.0).otherwise(F.greatest(1.0 - dot(a, b) / norm, F.lit(0.0)))


DISTANCES = {"l2": l2, "ip": inner_product_distance, "cosine": cosine_distance}


def similarity(metric: str, distance: Column) -> Column:
    """Similarity in 0 .. 1 of a distance."""
    return F.greatest(1.0 - distance, F.lit(0.0)) if metric == "cosine" else 1.0 / (1.0 + F.greatest(distance, F.lit(0.0)))


def vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def sq8(v: Column) -> Column:
    """Codes 0 .. 255 of a vector between its least and greatest value."""
    low, high = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    span = high - low
    return F.transform(v, lambda x: F.when(span <= 0, F.lit(0)).otherwise(F.round((x.cast("double") - low) / span * 255).cast("int")))


def sq8_decode(codes: Column, low: Column, high: Column) -> Column:
    return F.transform(codes, lambda c: low + c * (high - low) / 255.0)


def sign_bits(v: Column, width: int = 64) -> Column:
    """One bit per dimension (set if positive), packed in longs of `width` bits."""
    n = F.ceil(F.size(v) / width).cast("int")
    word = lambda w: F.aggregate(
        F.slice(v, w * width + 1, F.lit(width)), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    )
    return F.transform(F.sequence(F.lit(0), n - 1), word)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


# ----------------------------------------------------------------------- geo

# Sphere radius in metres, latitude bounds of the projection, units in metres.
EARTH_RADIUS_M = 6372797.560856
LAT_LIMIT, LON_LIMIT = 85.05112878, 180.0
UNIT_M = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.34}


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres along the sphere between two points given in degrees."""
    u = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    v = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return 2.0 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v)))


def let(x: Column, use) -> Column:
    """use(x), where x is computed once however often it is used."""
    return F.transform(F.array(x), use)[0]


def _folded(move, shift: int, mask: int):
    return lambda v: v.bitwiseOR(move(v, shift)).bitwiseAND(F.lit(mask))


# Fixed values of the two functions below: the usual shifts and masks that part or join every second bit of a word.
def _spread(x: Column) -> Column:
    """The low 26 bits of x at the even places of 52."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = let(x, _folded(F.shiftleft, shift, mask))
    return x


def _squash(x: Column) -> Column:
    x = x.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = let(x, _folded(F.shiftright, shift, mask))
    return x


def _cell(x: Column, limit: float) -> Column:
    return F.least(F.floor((x + limit) / (2 * limit) * (1 << 26)).cast("long"), F.lit((1 << 26) - 1).cast("long"))


def geohash52(lon: Column, lat: Column, lat_limit: float = LAT_LIMIT) -> Column:
    """52-bit cell number: latitude in the even bits, longitude in the odd ones."""
    return _spread(_cell(lat, lat_limit)).bitwiseOR(F.shiftleft(_spread(_cell(lon, LON_LIMIT)), 1))


def geohash52_point(code: Column) -> Column:
    """Centre of a cell, as a struct of lon and lat."""
    lat, lon = _squash(code), _squash(F.shiftright(code, 1))
    centre = lambda i, limit: (i + 0.5) / float(1 << 26) * (2 * limit) - limit
    return F.struct(centre(lon, LON_LIMIT).alias("lon"), centre(lat, LAT_LIMIT).alias("lat"))


BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash_text(lon: Column, lat: Column) -> Column:
    """The standard 11-character geohash (latitude to +-90) of a point's cell, of 52 bits: the last character is 0."""
    char = lambda code, i: F.substring(F.lit(BASE32), (F.shiftright(code, 52 - 5 * (i + 1)).bitwiseAND(F.lit(31).cast("long")) + 1).cast("int"), F.lit(1))
    text = lambda code: F.concat(*(char(code, i) for i in range(10)), F.lit("0"))
    return let(geohash52_point(geohash52(lon, lat)), lambda at: let(geohash52(at["lon"], at["lat"], 90.0), text))
