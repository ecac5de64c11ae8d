"""Hashes in long form: (key, field, value) with an expiry per field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keyspace import scan_within
from .sets import sample


def set_fields(log: DataFrame, key: str = "key", field: str = "field", value: str = "value", seq: str = "seq") -> DataFrame:
    """HSET, HMSET: the last value of each field."""
    return log.groupBy(key, field).agg(F.max_by(value, seq).alias(value))


def set_fields_if_absent(new: DataFrame, store: DataFrame, key: str = "key", field: str = "field") -> DataFrame:
    """HSETNX: the store with the fields of new that it lacks."""
    return store.unionByName(new.join(store, [key, field], "left_anti").select(*store.columns))


def get_fields(store: DataFrame, request: DataFrame, key: str = "key", field: str = "field") -> DataFrame:
    """HGET, HMGET, HEXISTS, HSTRLEN: each requested field with its value or null."""
    return request.join(store, [key, field], "left")


def delete_fields(store: DataFrame, gone: DataFrame, key: str = "key", field: str = "field") -> DataFrame:
    """HDEL: the store without the fields in gone."""
    return store.join(gone, [key, field], "left_anti")


def increment_fields(log: DataFrame, key: str = "key", field: str = "field", delta: str = "delta") -> DataFrame:
    """HINCRBY, HINCRBYFLOAT: the sum of each field's changes."""
    return log.groupBy(key, field).agg(F.try_sum(delta).alias("value"))


def as_map(store: DataFrame, key: str = "key", field: str = "field", value: str = "value") -> DataFrame:
    """HGETALL: a map of each key's fields."""
    return store.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, value)))).alias("fields"))


def shape(store: DataFrame, key: str = "key", field: str = "field") -> DataFrame:
    """HLEN and HKEYS of each key."""
    return store.groupBy(key).agg(F.count("*").alias("n_fields"), F.array_sort(F.collect_set(field)).alias("keys"))


def expire_fields(store: DataFrame, due: DataFrame, condition: str = "", key: str = "key", field: str = "field") -> DataFrame:
    """HEXPIRE, HPEXPIREAT: set expire_at from due (key, field, at) under NX, XX, GT or LT."""
    rows = store.join(due, [key, field], "left")
    old, new = F.col("expire_at"), F.col("at")
    # no expiry counts as an infinite one
    test = {"": F.lit(True), "NX": old.isNull(), "XX": old.isNotNull(), "GT": old.isNotNull() & (new > old), "LT": old.isNull() | (new < old)}[condition]
    return rows.withColumn("expire_at", F.when(new.isNotNull() & test, new).otherwise(old)).select(*store.columns)


def remaining(store: DataFrame, request: DataFrame, as_of_ms: int, key: str = "key", field: str = "field") -> DataFrame:
    """HTTL, HPTTL: ms left of each requested field; -1 without expiry, -2 if missing or past."""
    rows = request.join(store.withColumn("_there", F.lit(True)), [key, field], "left")
    left = F.col("expire_at") - as_of_ms
    code = F.when(F.col("_there").isNull() | (left <= 0), -2).when(left.isNull(), -1).otherwise(left)
    return rows.select(key, field, code.cast("long").alias("ttl_ms"))


def set_fields_expiring(store: DataFrame, new: DataFrame, condition: str = "", key: str = "key", field: str = "field", value: str = "value") -> DataFrame:
    """HSETEX: the store (key, field, value, expire_at) after one write per field; FNX, FXX: a key's fields are written only if none, or all, of them exist."""
    fresh = new.select(key, field, F.col(value).alias("_value"), F.col("expire_at").alias("_at"), F.lit(True).alias("_write"))
    rows = store.select(key, field, value, "expire_at", F.lit(True).alias("_there")).join(fresh, [key, field], "full_outer")
    if condition:
        met = rows.where("_write").groupBy(key).agg((F.count("_there") == (F.lit(0) if condition == "FNX" else F.count("*"))).alias("_ok"))
        rows = rows.join(met, key, "left").withColumn("_write", F.col("_write") & F.col("_ok"))
    writes = F.coalesce("_write", F.lit(False))
    return rows.where(F.col("_there").isNotNull() | writes).select(key, field, F.when(writes, F.col("_value")).otherwise(F.col(value)).alias(value), F.when(writes, F.col("_at")).otherwise(F.col("expire_at")).alias("expire_at"))


def get_and_delete_fields(store: DataFrame, request: DataFrame, key: str = "key", field: str = "field") -> tuple[DataFrame, DataFrame]:
    """HGETDEL: (the requested fields with their values or null, the store without them)."""
    return get_fields(store, request, key, field), delete_fields(store, request.select(key, field), key, field)


def get_and_expire_fields(store: DataFrame, request: DataFrame, key: str = "key", field: str = "field") -> tuple[DataFrame, DataFrame]:
    """HGETEX: (values, store): each requested field (key, field, at) gets the expiry `at`; null persists it (HPERSIST)."""
    asked = request.select(key, field, F.col("at").alias("_at"), F.lit(True).alias("_asked"))
    after = store.join(asked, [key, field], "left").withColumn("expire_at", F.when(F.col("_asked"), F.col("_at")).otherwise(F.col("expire_at")))
    return get_fields(store, request.select(key, field), key, field), after.select(*store.columns)


def persist_fields(store: DataFrame, request: DataFrame, key: str = "key", field: str = "field") -> DataFrame:
    """HPERSIST: the requested fields without their expiry."""
    return get_and_expire_fields(store, request.withColumn("at", F.lit(None).cast("long")), key, field)[1]


def import_rows(rows: DataFrame, names: list[str], key: str = "key", values: str = "values") -> DataFrame:
    """HIMPORT: rows (key, array of values) under a prepared list of field names: (key, field, value)."""
    pairs = F.zip_with(F.array(*(F.lit(n) for n in names)), values, lambda f, v: F.struct(f.alias("field"), v.alias("value")))
    return rows.select(key, F.inline(pairs))


def scan_fields(store: DataFrame, cursor: int, count: int, pattern: str | None = None, key: str = "key", field: str = "field") -> DataFrame:
    """HSCAN: the next page of each key's fields in the order of a hash, from a cursor on (`slot` of the last row seen); whole
    slots, so none is lost. Of a page, only fields that match the pattern are returned."""
    return scan_within(store, cursor, count, pattern, key, field)


def sample_fields(store: DataFrame, count: int, seed: int, key: str = "key", field: str = "field") -> DataFrame:
    """HRANDFIELD: count fields of each key in the order of a seeded hash; a negative count repeats fields."""
    return sample(store, count, seed, key, field)
