"""Streams: entries (key, ms, seq, ..) and a group's pending entries, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import before
from .leases import opens_window

#: Arrivals of a key that are ordered in one task.
BLOCK_ROWS = 1 << 20
#: Time of a group's entries that are ordered in one task.
BLOCK_MS = 3_600_000


def entry_range(entries: DataFrame, start: tuple[int, int], end: tuple[int, int], count: int | None = None, reverse: bool = False) -> DataFrame:
    """XRANGE, XREVRANGE: entries with start <= id <= end; the bounds on ms reach the scan."""
    found = entries.where(F.col("ms").between(start[0], end[0]))
    found = found.where((F.col("ms") > start[0]) | (F.col("seq") >= start[1])).where((F.col("ms") < end[0]) | (F.col("seq") <= end[1]))
    if count is None:
        return found
    order = [F.col("ms").desc(), F.col("seq").desc()] if reverse else [F.col("ms"), F.col("seq")]
    return found.orderBy(*order).limit(count)


def read_after(entries: DataFrame, last: DataFrame, count: int | None = None) -> DataFrame:
    """XREAD: entries behind the last id of each key (key, last_ms, last_seq), at most count per key."""
    found = entries.join(last, "key").where((F.col("ms") > F.col("last_ms")) | ((F.col("ms") == F.col("last_ms")) & (F.col("seq") > F.col("last_seq"))))
    if count is not None:
        n = F.row_number().over(Window.partitionBy("key").orderBy("ms", "seq"))
        found = found.withColumn("_n", n).where(F.col("_n") <= count).drop("_n")
    return found.drop("last_ms", "last_seq")


def trim_to_length(entries: DataFrame, most: int) -> DataFrame:
    """XTRIM MAXLEN: the newest `most` entries of each key."""
    n = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ms"), F.desc("seq")))
    return entries.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def trim_to_id(entries: DataFrame, ms: int, seq: int = 0) -> DataFrame:
    """XTRIM MINID."""
    return entries.where((F.col("ms") > ms) | ((F.col("ms") == ms) & (F.col("seq") >= seq)))


def accepted(entries: DataFrame, arrival: str) -> DataFrame:
    """XADD with ids of its own: an entry is taken only if its id is above all that came before it."""
    rows = before(entries, ["key"], arrival, BLOCK_ROWS, "_top", F.struct("ms", "seq"), F.max)
    return rows.where(F.col("_top").isNull() | (F.struct("ms", "seq") > F.col("_top"))).drop("_top")


def idempotent(entries: DataFrame, producer: str = "producer", token: str = "token", window_ms: int = 100) -> DataFrame:
    """XADD IDMP: without an entry whose producer's same token was taken less than window_ms before; what is left out doesn't extend the window."""
    return opens_window(entries, ["key", producer, token], "ms", window_ms, "_taken", "seq").where("_taken").drop("_taken")


def deliver(entries: DataFrame, consumers: int, as_of_ms: Column) -> DataFrame:
    """XREADGROUP: each entry to one consumer of the group, by its id: the pending entries."""
    hashed = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("ms").cast("string"), F.col("seq").cast("string"))), 1, 8), 16, 10).cast("long")
    consumer = F.concat(F.lit("consumer"), hashed % consumers)
    return entries.select("key", "ms", "seq", consumer.alias("consumer"), as_of_ms.alias("delivery_ms"), F.lit(1).alias("delivery_count"))


def acknowledge(pending: DataFrame, acked: DataFrame) -> DataFrame:
    """XACK: the pending entries that are left."""
    return pending.join(acked, ["key", "ms", "seq"], "left_anti")


def pending_summary(pending: DataFrame) -> DataFrame:
    """XPENDING: count, least and greatest id of each consumer."""
    return pending.groupBy("key", "consumer").agg(F.count("*").alias("n"), F.min(F.struct("ms", "seq")).alias("_a"), F.max(F.struct("ms", "seq")).alias("_b")).select(
        "key", "consumer", "n", F.col("_a.ms").alias("first_ms"), F.col("_a.seq").alias("first_seq"), F.col("_b.ms").alias("last_ms"), F.col("_b.seq").alias("last_seq")
    )


def claim(pending: DataFrame, consumer, as_of_ms: int, min_idle_ms: int, count: int | None = None, cursor: tuple[int, int] = (0, 0)) -> DataFrame:
    """XCLAIM, XAUTOCLAIM: idle entries go to a consumer and are delivered once more; at most count per key, from a cursor on."""
    due = (F.lit(as_of_ms) - F.col("delivery_ms") >= min_idle_ms) & ((F.col("ms") > cursor[0]) | ((F.col("ms") == cursor[0]) & (F.col("seq") >= cursor[1])))
    rows = pending.withColumn("_due", due)
    if count is not None:
        n = F.row_number().over(Window.partitionBy("key", "_due").orderBy("ms", "seq"))
        rows = rows.withColumn("_due", F.col("_due") & (n <= count))
    return rows.select(
        "key", "ms", "seq",
        F.when(F.col("_due"), F.lit(consumer)).otherwise(F.col("consumer")).alias("consumer"),
        F.when(F.col("_due"), F.lit(as_of_ms)).otherwise(F.col("delivery_ms")).alias("delivery_ms"),
        (F.col("delivery_count") + F.col("_due").cast("int")).alias("delivery_count"),
        F.col("_due").alias("claimed"),
    )


def delete(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """XDEL: without the entries (key, ms, seq) asked for."""
    return entries.join(gone.select("key", "ms", "seq"), ["key", "ms", "seq"], "left_anti")


def delete_entries(entries: DataFrame, pending: DataFrame, gone: DataFrame, policy: str = "KEEPREF") -> tuple[DataFrame, DataFrame]:
    """XDELEX: (entries, pending). KEEPREF leaves pending references, DELREF drops them too, ACKED deletes only what no group has pending."""
    if policy == "ACKED":
        gone = gone.join(pending.select("key", "ms", "seq"), ["key", "ms", "seq"], "left_anti")
    return delete(entries, gone), delete(pending, gone) if policy == "DELREF" else pending


def acknowledge_and_delete(entries: DataFrame, pending: DataFrame, group, gone: DataFrame, policy: str = "KEEPREF") -> tuple[DataFrame, DataFrame]:
    """XACKDEL: XACK in one group (column `group` of pending), then XDELEX."""
    own = F.col("group") == F.lit(group)
    left = acknowledge(pending.where(own), gone.select("key", "ms", "seq")).unionByName(pending.where(~own))
    return delete_entries(entries, left, gone, policy)


#: XNACK: what becomes of the delivery count.
GIVEN_BACK = {"SILENT": -1, "FAIL": 0}
MOST_DELIVERIES = (1 << 63) - 1


def give_back(pending: DataFrame, given: DataFrame, mode: str = "FAIL") -> DataFrame:
    """XNACK: entries (key, ms, seq) go back to no consumer and are due at once. SILENT takes back a delivery, FAIL keeps the count, FATAL sets it to the greatest number."""
    asked = given.select("key", "ms", "seq").distinct().withColumn("_given", F.lit(True))
    count = F.col("delivery_count").cast("long")
    after = F.lit(MOST_DELIVERIES) if mode == "FATAL" else F.greatest(F.lit(0).cast("long"), count + GIVEN_BACK[mode])
    rows = pending.join(asked, ["key", "ms", "seq"], "left")
    own = F.col("_given").isNotNull()
    return rows.select("key", "ms", "seq", F.when(~own, F.col("consumer")).alias("consumer"), F.when(own, F.lit(0).cast("long")).otherwise(F.col("delivery_ms")).alias("delivery_ms"), F.when(own, after).otherwise(count).alias("delivery_count"))


def stream_info(entries: DataFrame) -> DataFrame:
    """XINFO STREAM: length, first, last and least ids of each key."""
    return entries.groupBy("key").agg(F.count("*").alias("length"), F.min(F.struct("ms", "seq")).alias("_a"), F.max(F.struct("ms", "seq")).alias("_b")).select(
        "key", "length", F.col("_a.ms").alias("first_ms"), F.col("_a.seq").alias("first_seq"), F.col("_b.ms").alias("last_ms"), F.col("_b.seq").alias("last_seq")
    )


def group_info(entries: DataFrame, groups: DataFrame, pending: DataFrame) -> DataFrame:
    """XINFO GROUPS: of each group (key, group, last_ms, last_seq) its consumers and pending entries, and the entries that it hasn't read."""
    held = pending.groupBy("key", "group").agg(F.countDistinct("consumer").alias("consumers"), F.count("*").alias("pending"))
    behind = entries.join(groups, "key").where(F.struct("ms", "seq") > F.struct("last_ms", "last_seq")).groupBy("key", "group").agg(F.count("*").alias("lag"))
    rows = groups.join(held, ["key", "group"], "left").join(behind, ["key", "group"], "left")
    return rows.select("key", "group", "last_ms", "last_seq", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("consumers", "pending", "lag")))


def set_id(meta: DataFrame, new: DataFrame) -> DataFrame:
    """XSETID: (key, last_ms, last_seq, entries_added, max_deleted_ms, max_deleted_seq) with the values of new; null keeps what is there."""
    names = [c for c in meta.columns if c != "key"]
    rows = meta.join(new.select("key", *(F.col(c).alias(f"_{c}") for c in names)), "key", "full_outer")
    return rows.select("key", *(F.coalesce(f"_{c}", c).alias(c) for c in names))


def configure(config: DataFrame, new: DataFrame) -> DataFrame:
    """XCFGSET: the idempotence window (key, duration_ms, max_size) of each stream."""
    return set_id(config, new)


def record_producer(state: DataFrame, new: DataFrame) -> DataFrame:
    """XIDMPRECORD: the state (key, producer, token, ms, seq) with the ids of new; a token that is known keeps its first id."""
    rows = state.unionByName(new.select(*state.columns))
    first = rows.groupBy("key", "producer", "token").agg(F.min(F.struct("ms", "seq")).alias("_id"))
    return first.select("key", "producer", "token", "_id.ms", "_id.seq")


def pending_range(pending: DataFrame, as_of_ms: int, min_idle_ms: int, start: tuple[int, int], end: tuple[int, int], count: int, consumer=None) -> DataFrame:
    """XPENDING with IDLE and a range: the first count pending entries of each key, with how long they are idle."""
    rows = pending.withColumn("idle_ms", F.lit(as_of_ms) - F.col("delivery_ms")).where(F.col("idle_ms") >= min_idle_ms)
    if consumer is not None:
        rows = rows.where(F.col("consumer") == F.lit(consumer))
    n = F.row_number().over(Window.partitionBy("key").orderBy("ms", "seq"))
    return entry_range(rows, start, end).withColumn("_n", n).where(F.col("_n") <= count).drop("_n")


def read_group(entries: DataFrame, groups: DataFrame, consumers: int, as_of_ms: int) -> tuple[DataFrame, DataFrame]:
    """XGROUP CREATE and XREADGROUP in batch: (pending, groups). Entries behind each group's last id (key, group, last_ms, last_seq) go to its
    consumers in turn; the groups move on to the last entry."""
    new = entries.join(groups, "key").where(F.struct("ms", "seq") > F.struct("last_ms", "last_seq"))
    turn = before(new, ["key", "group"], "ms", BLOCK_MS, "_turn", F.lit(1), F.count, F.sum, "seq")
    consumer = F.concat(F.lit("consumer"), F.coalesce("_turn", F.lit(0)) % consumers)
    pending = turn.select("key", "group", "ms", "seq", consumer.alias("consumer"), F.lit(as_of_ms).alias("delivery_ms"), F.lit(1).alias("delivery_count"))
    last = new.groupBy("key", "group").agg(F.max(F.struct("ms", "seq")).alias("_last"))
    moved = groups.join(last, ["key", "group"], "left").select("key", "group", F.coalesce("_last.ms", "last_ms").alias("last_ms"), F.coalesce("_last.seq", "last_seq").alias("last_seq"))
    return pending, moved
