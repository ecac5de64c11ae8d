"""Strings and counters, folded from a mutation log of (key, seq, value or delta)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest(log: DataFrame, key: str = "key", seq: str = "seq", value: str = "value") -> DataFrame:
    """SET, MSET: the last value written to each key."""
    return log.groupBy(key).agg(F.max_by(value, seq).alias(value))


def set_if_absent(log: DataFrame, key: str = "key", seq: str = "seq", value: str = "value") -> DataFrame:
    """SETNX: the first value written to each key."""
    return log.groupBy(key).agg(F.min_by(value, seq).alias(value))


def set_all_if_absent(new: DataFrame, store: DataFrame, key: str = "key") -> DataFrame:
    """MSETNX: all rows of new if none of their keys exists, else none (asked before the rows are used)."""
    return new if new.join(store.select(key), key, "left_semi").isEmpty() else new.limit(0)


def get_many(store: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """MGET: the request's rows in its order, with null for a missing key."""
    return keys.join(store, key, "left")


def previous(log: DataFrame, key: str = "key", seq: str = "seq", value: str = "value") -> DataFrame:
    """GETSET: each write with the value it replaced."""
    return log.withColumn("old", F.lag(value).over(Window.partitionBy(key).orderBy(seq)))


def increment(log: DataFrame, key: str = "key", delta: str = "delta") -> DataFrame:
    """INCR, INCRBY, DECR, DECRBY, INCRBYFLOAT: the counter of each key; null where a 64-bit counter overflows."""
    return log.groupBy(key).agg(F.try_sum(delta).alias("value"))


def append(log: DataFrame, key: str = "key", seq: str = "seq", value: str = "value") -> DataFrame:
    """APPEND: the pieces of each key in order. The result is one value per key, as long as its pieces together."""
    parts = F.array_sort(F.collect_list(F.struct(seq, value)))
    return log.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[value]), "").alias("value"))


def bounded_increments(log: DataFrame, low: float | None = None, high: float | None = None, saturate: bool = True, key: str = "key", seq: str = "seq", delta: str = "delta") -> DataFrame:
    """INCREX: value and applied change after all steps; a step out of bounds is cut (saturate) or left out."""
    steps = F.array_sort(F.collect_list(F.struct(seq, F.col(delta).cast("long").alias("d"))))

    def step(state, s):
        wanted = state["value"] + s["d"]
        cut = wanted
        if low is not None:
            cut = F.greatest(cut, F.lit(int(low)).cast("long"))
        if high is not None:
            cut = F.least(cut, F.lit(int(high)).cast("long"))
        value = cut if saturate else F.when(cut == wanted, wanted).otherwise(state["value"])
        return F.struct(value.alias("value"), (value - state["value"]).alias("applied"))

    start = F.struct(F.lit(0).cast("long").alias("value"), F.lit(0).cast("long").alias("applied"))
    return log.groupBy(key).agg(F.aggregate(steps, start, step).alias("s")).select(key, "s.value", "s.applied")


def delete_if_equal(store: DataFrame, wanted: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """DELIFEQ, DELEX IFEQ: the store without the keys that hold the value asked for."""
    return store.join(wanted.select(key, value), [key, value], "left_anti")


def digest(store: DataFrame, value: str = "value") -> DataFrame:
    """DIGEST: a stable 16-digit digest of each value."""
    return store.withColumn("digest", value_digest(F.col(value)))


def _common_places(x: str, y: str) -> list[tuple[int, int]]:
    """Places of a longest common subsequence in both strings, from the end."""
    rows = [[0] * (len(y) + 1)]
    for c in x:
        prev, row = rows[-1], [0]
        for j, d in enumerate(y):
            row.append(prev[j] + 1 if c == d else max(prev[j + 1], row[j]))
        rows.append(row)
    i, j, found = len(x), len(y), []
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            found.append((i, j))
        elif rows[i - 1][j] >= rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return found


@F.arrow_udf(T.StringType())
def longest_common_subsequence(a: pa.Array, b: pa.Array) -> pa.Array:
    """LCS of two strings; of equally long ones, the one that takes from a's end first."""
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        out.append("".join(x[i] for i, _ in reversed(_common_places(x, y))))
    return pa.array(out, pa.string())


def set_many(store: DataFrame, new: DataFrame, condition: str = "", keep_ttl: bool = False, key: str = "key", value: str = "value") -> DataFrame:
    """SET, SETEX, PSETEX under NX, XX or IFEQ (new has the column `compare`), with GET: the store's rows (key, value, expire_at)
    after one write per key, and `old`, the value that a key had. new: key, value, expire_at (null: none; with keep_ttl the old one)."""
    fresh = new.select(key, F.col(value).alias("_value"), F.col("expire_at").alias("_at"), (F.col("compare") if condition == "IFEQ" else F.lit(None)).alias("_compare"), F.lit(True).alias("_write"))
    rows = store.select(key, value, "expire_at", F.lit(True).alias("_there")).join(fresh, key, "full_outer")
    there = F.col("_there").isNotNull()
    test = {"": F.lit(True), "NX": ~there, "XX": there, "IFEQ": there & (F.col(value) == F.col("_compare"))}[condition]
    writes = F.coalesce(F.col("_write") & test, F.lit(False))
    at = F.col("expire_at") if keep_ttl else F.col("_at")
    return rows.where(there | writes).select(key, F.when(writes, F.col("_value")).otherwise(F.col(value)).alias(value), F.when(writes, at).otherwise(F.col("expire_at")).alias("expire_at"), F.when(F.col("_write"), F.col(value)).alias("old"))


def set_all(store: DataFrame, new: DataFrame, condition: str = "", keep_ttl: bool = False, key: str = "key") -> DataFrame:
    """MSETEX: all rows of new, or none: under NX if none of their keys exists, under XX if all do (asked before the rows are used)."""
    if condition:
        found = new.select(key).join(store.select(key), key, "left_semi" if condition == "NX" else "left_anti")
        if not found.isEmpty():
            return store
    return set_many(store, new, "", keep_ttl, key).drop("old")


def get_and_delete(store: DataFrame, request: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """GETDEL: (the requested keys with their values or null, the store without them)."""
    return get_many(store, request, key), store.join(request.select(key), key, "left_anti")


def get_and_expire(store: DataFrame, request: DataFrame, key: str = "key", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """GETEX: (values, store): each requested key (key, at) gets the expiry `at`; null persists it."""
    asked = request.select(key, F.col("at").alias("_at"), F.lit(True).alias("_asked"))
    rows = store.join(asked, key, "left")
    after = rows.withColumn("expire_at", F.when(F.col("_asked"), F.col("_at")).otherwise(F.col("expire_at"))).select(*store.columns)
    return request.select(key).join(store.select(key, value), key, "left"), after


def value_digest(value: Column) -> Column:
    """DIGEST of a value: the first 16 hexadecimal digits of its MD5, a hash that other engines have too."""
    return F.substring(F.md5(value), 1, 16)


def delete_if(store: DataFrame, wanted: DataFrame, condition: str = "IFEQ", key: str = "key", value: str = "value") -> DataFrame:
    """DELEX: the store without the keys whose value equals (IFEQ) or differs from (IFNE) that of wanted; IFDEQ, IFDNE compare digests."""
    asked = wanted.select(key, F.col(value).alias("_wanted"), F.lit(True).alias("_asked"))
    own = value_digest(F.col(value)) if condition.startswith("IFD") else F.col(value)
    same = own.eqNullSafe(F.col("_wanted"))
    gone = F.coalesce(F.col("_asked"), F.lit(False)) & (same if condition.endswith("EQ") else ~same)
    return store.join(asked, key, "left").where(~gone).select(*store.columns)


MATCH = T.ArrayType(T.StructType().add("a_start", "integer").add("a_end", "integer").add("b_start", "integer").add("b_end", "integer").add("length", "integer"))


@F.arrow_udf(MATCH)
def common_ranges(a: pa.Array, b: pa.Array) -> pa.Array:
    """LCS IDX: the runs of the subsequence that `longest_common_subsequence` gives, from the end, as ranges of both strings (both ends included)."""
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        runs: list[dict] = []
        for i, j in _common_places(x, y):
            last = runs[-1] if runs else None
            if last and last["a_start"] == i + 1 and last["b_start"] == j + 1:
                last |= {"a_start": i, "b_start": j, "length": last["length"] + 1}
            else:
                runs.append({"a_start": i, "a_end": i, "b_start": j, "b_end": j, "length": 1})
        out.append(runs)
    return pa.array(out, pa.list_(pa.struct([(n, pa.int32()) for n in ("a_start", "a_end", "b_start", "b_end", "length")])))


def common_length(a: Column, b: Column) -> Column:
    """LCS LEN."""
    return F.length(longest_common_subsequence(a, b))
