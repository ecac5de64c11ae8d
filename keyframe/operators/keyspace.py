"""Keys of all types: (key, type, expire_at): expiry, patterns, scans, copies, external sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import glob_to_regex


def matching(rows: DataFrame, pattern: str, key: str = "key") -> DataFrame:
    """KEYS, SCAN MATCH; a plain beginning becomes a prefix test that reaches the scan."""
    stem = pattern[:-1]
    if pattern.endswith("*") and not any(c in stem for c in "*?[\\"):
        return rows.where(F.col(key).startswith(stem))
    return rows.where(F.col(key).rlike(glob_to_regex(pattern)))


def remaining_ms(expire_at: Column, as_of_ms: int, there: Column) -> Column:
    """PTTL: ms left; -1 without expiry, -2 if missing or past."""
    left = expire_at - as_of_ms
    return F.when(~F.coalesce(there, F.lit(False)) | (left <= 0), -2).when(expire_at.isNull(), -1).otherwise(left).cast("long")


def expire(rows: DataFrame, at: Column, condition: str = "") -> DataFrame:
    """EXPIRE, PEXPIREAT with NX, XX, GT or LT; no expiry counts as an infinite one."""
    old = F.col("expire_at")
    test = {"": F.lit(True), "NX": old.isNull(), "XX": old.isNotNull(), "GT": old.isNotNull() & (at > old), "LT": old.isNull() | (at < old)}[condition]
    return rows.withColumn("expire_at", F.when(test, at).otherwise(old))


def scan(rows: DataFrame, cursor: int, count: int, key: str = "key") -> DataFrame:
    """SCAN: the next page in the order of a hash of the key; its last `slot` is the next cursor (whole slots, so none is lost)."""
    ahead = rows.withColumn("slot", F.xxhash64(key)).where(F.col("slot") > cursor)
    last = ahead.select("slot").orderBy("slot").limit(count).agg(F.max("slot").alias("_last"))  # each task keeps count rows
    return ahead.join(F.broadcast(last), F.col("slot") <= F.col("_last")).drop("_last")


def copy(rows: DataFrame, source, target, replace: bool = False, key: str = "key") -> DataFrame:
    """COPY: rows of one key under another; without replace only if that is free."""
    made = rows.where(F.col(key) == F.lit(source)).withColumn(key, F.lit(target).cast(rows.schema[key].dataType))
    if replace:
        return rows.where(F.col(key) != F.lit(target)).unionByName(made)
    return rows.unionByName(made.join(rows.select(key).distinct(), key, "left_anti"))


def rename(rows: DataFrame, source, target, key: str = "key") -> DataFrame:
    """RENAME: rows of source under target, which loses its own."""
    kept = rows.where(F.col(key) != F.lit(target)) if source != target else rows
    return kept.withColumn(key, F.when(F.col(key) == F.lit(source), F.lit(target).cast(rows.schema[key].dataType)).otherwise(F.col(key)))


def sort_by(members: DataFrame, external: DataFrame, member: str, weight: str, gets: list[str], limit: int | None = None, offset: int = 0, descending: bool = False) -> DataFrame:
    """SORT BY .. GET: members ordered by a column looked up in another table (missing: 0), with columns of it."""
    rows = members.join(external, member, "left")
    order = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    rows = rows.orderBy(order.desc() if descending else order.asc(), member)
    if limit is not None:
        rows = rows.offset(offset).limit(limit)
    return rows.select(member, *gets)


def swap(rows: DataFrame, first: int, second: int, db: str = "db") -> DataFrame:
    """SWAPDB."""
    return rows.withColumn(db, F.when(F.col(db) == first, second).when(F.col(db) == second, first).otherwise(F.col(db)))


def exists_count(rows: DataFrame, request: DataFrame, key: str = "key") -> DataFrame:
    """EXISTS, TOUCH: how many requested keys there are, repeats counted."""
    return request.join(rows.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n"))


def scan_within(rows: DataFrame, cursor: int, count: int, pattern: str | None = None, key: str = "key", member: str = "member") -> DataFrame:
    """HSCAN, SSCAN, ZSCAN: the next page of each key's members in the order of a hash of the member; whole slots, so none is lost."""
    ahead = rows.withColumn("slot", F.xxhash64(member)).where(F.col("slot") > cursor)
    place = F.dense_rank().over(Window.partitionBy(key).orderBy("slot"))
    page = ahead.withColumn("_place", place).where(F.col("_place") <= count).drop("_place")
    return page if pattern is None else matching(page, pattern, member)


def delete(rows: DataFrame, gone: DataFrame, key: str = "key") -> DataFrame:
    """DEL, UNLINK: without the keys asked for."""
    return rows.join(gone.select(key), key, "left_anti")


def persist(rows: DataFrame, request: DataFrame, key: str = "key") -> DataFrame:
    """PERSIST: the requested keys lose their expiry."""
    asked = request.select(key).distinct().withColumn("_asked", F.lit(True))
    return rows.join(asked, key, "left").withColumn("expire_at", F.when(F.col("_asked").isNull(), F.col("expire_at"))).select(*rows.columns)


def size(rows: DataFrame, as_of_ms: int) -> DataFrame:
    """DBSIZE: live keys."""
    return rows.where(F.col("expire_at").isNull() | (F.col("expire_at") > as_of_ms)).agg(F.count("*").alias("n"))


def move_to(rows: DataFrame, request: DataFrame, target: int, replace: bool = False, key: str = "key", db: str = "db") -> DataFrame:
    """MOVE: the requested keys (key, db) go to another database; without replace only where it hasn't the key."""
    asked = request.select(key, db).distinct().withColumn("_asked", F.lit(True))
    held = rows.where(F.col(db) == target).select(key).distinct().withColumn("_held", F.lit(True))
    marked = rows.join(asked, [key, db], "left").join(held, key, "left").withColumn("_go", F.col("_asked").isNotNull() & (F.col(db) != target))
    if replace:
        arriving = marked.where("_go").select(key).distinct().withColumn("_new", F.lit(True))
        marked = marked.join(arriving, key, "left").where((F.col(db) != target) | F.col("_new").isNull())
    else:
        marked = marked.withColumn("_go", F.col("_go") & F.col("_held").isNull())
    return marked.withColumn(db, F.when(F.col("_go"), F.lit(target)).otherwise(F.col(db))).select(*rows.columns)


def random_key(rows: DataFrame, seed: int, key: str = "key") -> DataFrame:
    """RANDOMKEY: the first key in the order of a seeded hash."""
    return rows.select(key).orderBy(F.xxhash64(F.lit(seed), key), key).limit(1)


def rename_if_free(rows: DataFrame, source, target, key: str = "key") -> DataFrame:
    """RENAMENX: rows of source under target, if that is free (asked before the rows are used)."""
    return rename(rows, source, target, key) if rows.where(F.col(key) == F.lit(target)).isEmpty() else rows


def stick(rows: DataFrame, request: DataFrame, on: bool = True, key: str = "key") -> DataFrame:
    """STICK, UNSTICK: set or clear the column `sticky` of the requested keys. STICKY selects it."""
    asked = request.select(key).distinct().withColumn("_asked", F.lit(True))
    return rows.join(asked, key, "left").withColumn("sticky", F.when(F.col("_asked"), F.lit(on)).otherwise(F.col("sticky"))).select(*rows.columns)


def dump(rows: DataFrame, key: str = "key") -> DataFrame:
    """DUMP: a key's rows as one JSON text, in their order as text; `from_json` restores them."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rest)))).alias("dump"))
