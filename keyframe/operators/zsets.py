"""Sorted sets: rows (key, member, score), ordered by score and then by the member's bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keyspace import scan_within
from .lists import first_with_rows
from .sets import cardinality, intersect, sample


def ranked(rows: DataFrame, reverse: bool = False, key: str = "key", member: str = "member", score: str = "score") -> DataFrame:
    """ZRANK, ZREVRANK of every member (from 0)."""
    order = [F.col(score).desc(), F.col(member).desc()] if reverse else [F.col(score), F.col(member)]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def by_rank(rows: DataFrame, start: int, stop: int, reverse: bool = False, key: str = "key", member: str = "member", score: str = "score") -> DataFrame:
    """ZRANGE, ZREVRANGE: ranks start .. stop, both included; negative ones count from the end."""
    if start >= 0 and stop >= 0:  # a bound that Spark pushes before the exchange
        return ranked(rows, reverse, key, member, score).where((F.col("rank") >= start) & (F.col("rank") <= stop))
    n = F.count("*").over(Window.partitionBy(key))
    at = lambda i: F.lit(i) if i >= 0 else F.col("_n") + i
    return ranked(rows, reverse, key, member, score).withColumn("_n", n).where((F.col("rank") >= at(start)) & (F.col("rank") <= at(stop))).drop("_n")


def in_range(c: Column, low, high, low_open: bool = False, high_open: bool = False) -> Column:
    """Whether c is within bounds (None: open-ended), each of which may be excluded."""
    test = F.lit(True)
    if low is not None:
        test = test & (c > low if low_open else c >= low)
    if high is not None:
        test = test & (c < high if high_open else c <= high)
    return test


def by_score(rows: DataFrame, low, high, low_open: bool = False, high_open: bool = False, score: str = "score") -> DataFrame:
    """ZRANGEBYSCORE, ZCOUNT: rows with scores in a range (the filter reaches the scan)."""
    return rows.where(in_range(F.col(score), low, high, low_open, high_open))


def by_member(rows: DataFrame, low, high, low_open: bool = False, high_open: bool = False, member: str = "member") -> DataFrame:
    """ZRANGEBYLEX, ZLEXCOUNT: rows with members in a range, by bytes."""
    return rows.where(in_range(F.col(member), low, high, low_open, high_open))


def without_ranks(rows: DataFrame, start: int, stop: int, key: str = "key", member: str = "member", score: str = "score") -> DataFrame:
    """ZREMRANGEBYRANK."""
    gone = by_rank(rows, start, stop, False, key, member, score)
    return rows.join(gone.select(key, member), [key, member], "left_anti")


def pop(rows: DataFrame, count: int = 1, highest: bool = False, key: str = "key", member: str = "member", score: str = "score") -> tuple[DataFrame, DataFrame]:
    """ZPOPMIN, ZPOPMAX, ZMPOP: (popped, rest)."""
    numbered = ranked(rows, highest, key, member, score)
    return numbered.where(F.col("rank") < count).drop("rank"), numbered.where(F.col("rank") >= count).drop("rank")


def add(rows: DataFrame, new: DataFrame, condition: str = "", key: str = "key", member: str = "member", score: str = "score") -> DataFrame:
    """ZADD with NX (new members only), XX (known only), GT or LT (only to a greater or smaller score; adds new ones)."""
    both = rows.join(new.select(key, member, F.col(score).alias("_new")), [key, member], "full_outer")
    old, fresh = F.col(score), F.col("_new")
    value = {
        "": F.coalesce(fresh, old),
        "NX": F.coalesce(old, fresh),
        "XX": F.when(old.isNotNull(), F.coalesce(fresh, old)),
        "GT": F.greatest(old, fresh),
        "LT": F.least(old, fresh),
    }[condition]
    return both.select(key, member, value.alias(score)).where(F.col(score).isNotNull())


def increment(log: DataFrame, key: str = "key", member: str = "member", delta: str = "delta") -> DataFrame:
    """ZINCRBY: the sum of each member's increments."""
    return log.groupBy(key, member).agg(F.sum(delta).alias("score"))


def combine(rows: DataFrame, keys: list, operation: str, weights: list[float] | None = None, aggregate: str = "sum", key: str = "key", member: str = "member", score: str = "score") -> DataFrame:
    """ZUNION, ZINTER: members of any or all keys; their weighted scores summed, or the least or greatest. One aggregate by member."""
    weights = weights or [1.0] * len(keys)
    weight = F.coalesce(*(F.when(F.col(key) == F.lit(k), F.lit(float(w))) for k, w in zip(keys, weights, strict=True)))
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[aggregate]
    found = rows.where(F.col(key).isin(keys)).withColumn("_s", weight * F.col(score))
    found = found.groupBy(member).agg(fold("_s").alias(score), F.count("*").alias("_n"))
    return (found.where(F.col("_n") == len(keys)) if operation == "inter" else found).select(member, score)


def difference(rows: DataFrame, keys: list, key: str = "key", member: str = "member", score: str = "score") -> DataFrame:
    """ZDIFF: members of the first key that no other has, with its scores."""
    found = rows.where(F.col(key).isin(keys)).groupBy(member)
    found = found.agg(F.max(F.when(F.col(key) == F.lit(keys[0]), F.col(score))).alias(score), F.bool_or(F.col(key) != F.lit(keys[0])).alias("_other"))
    return found.where(F.col(score).isNotNull() & ~F.col("_other")).select(member, score)


def scores(rows: DataFrame, request: DataFrame, key: str = "key", member: str = "member") -> DataFrame:
    """ZSCORE, ZMSCORE: each requested member with its score or null."""
    return request.join(rows, [key, member], "left")


def remove(rows: DataFrame, gone: DataFrame, key: str = "key", member: str = "member") -> DataFrame:
    """ZREM."""
    return rows.join(gone.select(key, member), [key, member], "left_anti")


def without_scores(rows: DataFrame, low, high, low_open: bool = False, high_open: bool = False, score: str = "score") -> DataFrame:
    """ZREMRANGEBYSCORE."""
    return rows.where(~F.coalesce(in_range(F.col(score), low, high, low_open, high_open), F.lit(False)))


def without_members(rows: DataFrame, low, high, low_open: bool = False, high_open: bool = False, member: str = "member") -> DataFrame:
    """ZREMRANGEBYLEX."""
    return rows.where(~F.coalesce(in_range(F.col(member), low, high, low_open, high_open), F.lit(False)))


def page(rows: DataFrame, by: str, limit: int, offset: int = 0, reverse: bool = False, key: str = "key", member: str = "member") -> DataFrame:
    """LIMIT of ZRANGEBYSCORE, ZREVRANGEBYSCORE, ZRANGEBYLEX, ZREVRANGEBYLEX: rows offset .. of each key in the order of by and member."""
    order = [F.col(c).desc() if reverse else F.col(c).asc() for c in dict.fromkeys((by, member))]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", place).where((F.col("_n") > offset) & (F.col("_n") <= offset + limit)).drop("_n")


def store(found: DataFrame, target, key: str = "key") -> DataFrame:
    """ZUNIONSTORE, ZINTERSTORE, ZDIFFSTORE, ZRANGESTORE: found (member, score) under a key."""
    return found.select(F.lit(target).alias(key), "member", "score")


def replace(rows: DataFrame, found: DataFrame, target, key: str = "key") -> DataFrame:
    """The sorted sets after a store: target holds found and nothing else."""
    return rows.where(F.col(key) != F.lit(target)).unionByName(store(found, target, key))


def intersection_size(rows: DataFrame, keys: list, limit: int = 0, key: str = "key", member: str = "member") -> DataFrame:
    """ZINTERCARD."""
    return cardinality(intersect(rows, keys, key, member), limit)


def sample_members(rows: DataFrame, count: int, seed: int, key: str = "key", member: str = "member", score: str = "score") -> DataFrame:
    """ZRANDMEMBER, with scores: count members of each key in the order of a seeded hash; a negative count repeats members."""
    return sample(rows, count, seed, key, member).join(rows.select(key, member, score), [key, member])


def scan_members(rows: DataFrame, cursor: int, count: int, pattern: str | None = None, key: str = "key", member: str = "member") -> DataFrame:
    """ZSCAN."""
    return scan_within(rows, cursor, count, pattern, key, member)


def pop_first(rows: DataFrame, keys: list, count: int = 1, highest: bool = False, key: str = "key", member: str = "member", score: str = "score") -> tuple[DataFrame, DataFrame]:
    """ZMPOP: (popped, rest) of the first of the keys that isn't empty."""
    own = first_with_rows(rows, keys, key)
    popped, left = pop(rows.where(own), count, highest, key, member, score)
    return popped, left.unionByName(rows.where(~own))
