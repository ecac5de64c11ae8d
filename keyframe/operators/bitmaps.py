"""Bitmaps as rows (key, offset) of their set bits; bit 0 is the highest bit of byte 0.

The row form has no size limit and joins, counts and combines by key with map-side
aggregation. Packed bytes are made only for fields of a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_bits(log: DataFrame, key: str = "key", offset: str = "offset", bit: str = "bit", seq: str = "seq") -> DataFrame:
    """SETBIT: the offsets that are 1 after all writes."""
    return log.groupBy(key, offset).agg(F.max_by(bit, seq).alias("_b")).where("_b = 1").drop("_b")


def count(bits: DataFrame, start: int | None = None, end: int | None = None, key: str = "key", offset: str = "offset", unit: int = 8) -> DataFrame:
    """BITCOUNT: set bits of each key between two units (bytes: 8, bits: 1), both included."""
    rows = bits.select(key, offset).distinct()
    if start is not None:
        rows = rows.where(F.col(offset).between(start * unit, (end + 1) * unit - 1))
    return rows.groupBy(key).agg(F.count("*").alias("n_bits"))


def combine(bits: DataFrame, operation: str, key: str = "key", offset: str = "offset", keys: list | None = None) -> DataFrame:
    """BITOP AND, OR, XOR, DIFF (first key without the others), DIFF1 (the others without the first), ANDOR (the first and any other), ONE (in exactly one): the offsets of the result."""
    rows = bits.select(key, offset).distinct()
    if keys is not None:
        rows = rows.where(F.col(key).isin(keys))
    n = len(keys) if keys is not None else None
    seen = rows.groupBy(offset).agg(F.count("*").alias("n"), F.max(F.col(key) == F.lit(keys[0]) if keys else F.lit(False)).alias("first"))
    test = {
        "and": F.col("n") == n,
        "or": F.lit(True),
        "xor": F.col("n") % 2 == 1,
        "one": F.col("n") == 1,
        "diff": F.col("first") & (F.col("n") == 1),
        "diff1": ~F.col("first"),
        "andor": F.col("first") & (F.col("n") > 1),
    }
    return seen.where(test[operation]).select(offset)


def invert(bits: DataFrame, sizes: DataFrame, key: str = "key", offset: str = "offset", n_bytes: str = "n_bytes") -> DataFrame:
    """BITOP NOT: the offsets that are 0 within each key's bytes."""
    every = sizes.select(key, F.explode(F.sequence(F.lit(0), F.col(n_bytes) * 8 - 1)).alias(offset))
    return every.join(bits, [key, offset], "left_anti")


def first_bit(bits: DataFrame, bit: int, key: str = "key", offset: str = "offset") -> DataFrame:
    """BITPOS: the first offset that is 1, or that is 0, of each key."""
    if bit:
        return bits.groupBy(key).agg(F.min(offset).alias("position"))
    # the first gap: the set bits before it are 0, 1, 2 ..
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(key).orderBy(offset)) - 1
    run = bits.select(key, offset).distinct().withColumn("_p", place).where(F.col("_p") == F.col(offset))
    runs = run.groupBy(key).agg((F.max(offset) + 1).alias("position"))
    return bits.select(key).distinct().join(runs, key, "left").select(key, F.coalesce("position", F.lit(0)).alias("position"))


def field_increment(value: Column, delta: Column, bits: int, signed: bool = True, overflow: str = "wrap") -> Column:
    """BITFIELD INCRBY of a field of up to 62 bits: wrap around, saturate, or fail (null)."""
    low, high = (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if signed else (0, (1 << bits) - 1)
    total = value.cast("long") + delta.cast("long")
    if overflow == "sat":
        return F.greatest(F.lit(low).cast("long"), F.least(F.lit(high).cast("long"), total))
    if overflow == "fail":
        return F.when(total.between(low, high), total)
    size = 1 << bits
    return F.pmod(total - low, F.lit(size).cast("long")) + low


def field_value(bits: DataFrame, start: int, width: int, signed: bool = True, key: str = "key", offset: str = "offset") -> DataFrame:
    """BITFIELD GET, BITFIELD_RO: the number of `width` (up to 62) bits from bit `start` on, the first the highest; unset bits are 0."""
    own = bits.select(key, offset).distinct().where(F.col(offset).between(start, start + width - 1))
    weight = F.round(F.pow(F.lit(2.0), F.lit(start + width - 1) - F.col(offset))).cast("long")
    sums = bits.select(key).distinct().join(own.groupBy(key).agg(F.sum(weight).alias("_v")), key, "left")
    value = F.coalesce("_v", F.lit(0).cast("long"))
    return sums.select(key, (F.when(value >= 1 << (width - 1), value - (1 << width)).otherwise(value) if signed else value).alias("value"))


def set_field(bits: DataFrame, start: int, width: int, values: DataFrame, key: str = "key", offset: str = "offset", value: str = "value") -> DataFrame:
    """BITFIELD SET: each key of values has its number in `width` bits from bit `start` on (wrapped to the width)."""
    place = F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("_i")
    bit = F.getbit(F.col(value).cast("long"), F.lit(width - 1) - F.col("_i"))
    new = values.select(key, value, place).where(bit == 1)
    new = new.select(key, (F.col("_i") + start).cast(bits.schema[offset].dataType).alias(offset))
    written = values.select(key).distinct().withColumn("_w", F.lit(True))
    kept = bits.select(key, offset).join(written, key, "left").where(F.col("_w").isNull() | ~F.col(offset).between(start, start + width - 1)).drop("_w")
    return kept.unionByName(new)


def get_bits(bits: DataFrame, request: DataFrame, key: str = "key", offset: str = "offset") -> DataFrame:
    """GETBIT: each requested (key, offset) with its bit."""
    there = bits.select(key, offset).distinct().withColumn("_b", F.lit(1))
    return request.join(there, [key, offset], "left").withColumn("bit", F.coalesce("_b", F.lit(0))).drop("_b")
