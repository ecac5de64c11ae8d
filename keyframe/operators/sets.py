"""Set algebra over rows (key, member)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def members(rows: DataFrame, key_value, key: str = "key", member: str = "member") -> DataFrame:
    """SMEMBERS."""
    return rows.where(F.col(key) == F.lit(key_value)).select(member).distinct()


def intersect(rows: DataFrame, keys: list, key: str = "key", member: str = "member") -> DataFrame:
    """SINTER: members of all keys. One aggregate by member, whatever the number of keys."""
    found = rows.where(F.col(key).isin(keys)).select(key, member).distinct()
    return found.groupBy(member).agg(F.count("*").alias("_n")).where(F.col("_n") == len(set(keys))).select(member)


def union(rows: DataFrame, keys: list, key: str = "key", member: str = "member") -> DataFrame:
    """SUNION."""
    return rows.where(F.col(key).isin(keys)).select(member).distinct()


def difference(rows: DataFrame, keys: list, key: str = "key", member: str = "member") -> DataFrame:
    """SDIFF: members of the first key that no other key has."""
    first, rest = keys[0], [k for k in keys[1:]]
    found = rows.where(F.col(key).isin(keys)).groupBy(member)
    found = found.agg(F.bool_or(F.col(key) == F.lit(first)).alias("_in"), F.bool_or(F.col(key).isin(rest) if rest else F.lit(False)).alias("_out"))
    return found.where("_in AND NOT _out").select(member)


def cardinality(found: DataFrame, limit: int = 0) -> DataFrame:
    """SINTERCARD, SUNIONCARD, SDIFFCARD: rows of found, at most limit (0: no limit)."""
    return (found.limit(limit) if limit else found).agg(F.count("*").alias("n"))


def sizes(rows: DataFrame, key: str = "key", member: str = "member") -> DataFrame:
    """SCARD of every key."""
    return rows.select(key, member).distinct().groupBy(key).agg(F.count("*").alias("n"))


def is_member(rows: DataFrame, request: DataFrame, key: str = "key", member: str = "member") -> DataFrame:
    """SISMEMBER, SMISMEMBER: each requested (key, member) with a flag."""
    there = rows.select(key, member).distinct().withColumn("_there", F.lit(True))
    return request.join(there, [key, member], "left").select(*request.columns, F.coalesce("_there", F.lit(False)).alias("is_member"))


def add(rows: DataFrame, new: DataFrame, key: str = "key", member: str = "member") -> DataFrame:
    """SADD."""
    return rows.select(key, member).union(new.select(key, member)).distinct()


def remove(rows: DataFrame, gone: DataFrame, key: str = "key", member: str = "member") -> DataFrame:
    """SREM."""
    return rows.join(gone, [key, member], "left_anti")


def move(rows: DataFrame, source, target, member_value, key: str = "key", member: str = "member") -> DataFrame:
    """SMOVE: the member changes its key if the source has it."""
    hit = (F.col(key) == F.lit(source)) & (F.col(member) == F.lit(member_value))
    return rows.withColumn(key, F.when(hit, F.lit(target).cast(rows.schema[key].dataType)).otherwise(F.col(key))).select(key, member).distinct()


def store(found: DataFrame, target, key: str = "key", member: str = "member") -> DataFrame:
    """SINTERSTORE, SUNIONSTORE, SDIFFSTORE: found under a key."""
    return found.select(F.lit(target).alias(key), member)


def sample(rows: DataFrame, count: int, seed: int, key: str = "key", member: str = "member") -> DataFrame:
    """SRANDMEMBER, SPOP: count members of each key in the order of a seeded hash (rerunnable); a negative count repeats members."""
    distinct = rows.select(key, member).distinct()
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), member), member))
    if count >= 0:
        return distinct.withColumn("_n", place).where(F.col("_n") <= count).drop("_n")
    numbered = distinct.withColumn("_n", place)
    sizes_of = distinct.groupBy(key).agg(F.count("*").alias("_size"))
    draws = sizes_of.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(-count)))).withColumn("_n", (F.pmod(F.xxhash64(F.lit(seed), key, "_draw"), F.col("_size")) + 1).cast("int"))
    return draws.join(numbered, [key, "_n"]).select(key, member)


def pop(rows: DataFrame, count: int, seed: int, key: str = "key", member: str = "member") -> tuple[DataFrame, DataFrame]:
    """SPOP: (count members of each key in the order of a seeded hash, the rest)."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), member), member))
    numbered = rows.select(key, member).distinct().withColumn("_n", place)
    return numbered.where(F.col("_n") <= count).drop("_n"), numbered.where(F.col("_n") > count).drop("_n")
