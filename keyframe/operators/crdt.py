"""Replicated values merged from the rows of all replicas; a merge is a union and an aggregate.

Times are structs (physical_ms, logical, node), which order as the replicas' clocks do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLOCK = ["physical_ms", "logical", "node"]


def last_writer(rows: DataFrame, key: str = "key", value: str = "value", deleted: str = "deleted") -> DataFrame:
    """CRDT.SET, DEL: the value of the latest clock, unless that deletes."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(value, deleted), F.struct(*CLOCK)).alias("_l"))
    return last.where("NOT _l.deleted").select(key, f"_l.{value}")


def counter(rows: DataFrame, key: str = "key", node: str = "node", plus: str = "p", minus: str = "n") -> DataFrame:
    """CRDT.INCRBY: each node's sums only grow, so a merge takes their greatest; the value is their difference."""
    each = rows.groupBy(key, node).agg(F.max(plus).alias("p"), F.max(minus).alias("n"))
    return each.groupBy(key).agg((F.sum("p") - F.sum("n")).alias("value"))


def observed_set(adds: DataFrame, removes: DataFrame, key: str = "key", member: str = "member", tag: str = "tag") -> DataFrame:
    """CRDT.SADD, SREM: members with a tag that no remove has seen (adds win)."""
    return adds.join(removes.select(key, member, tag), [key, member, tag], "left_anti").select(key, member).distinct()


def collect_garbage(rows: DataFrame, before_ms: int, deleted: str = "deleted") -> DataFrame:
    """CRDT.GC: without tombstones older than a time."""
    return rows.where(~F.col(deleted) | (F.col("physical_ms") >= before_ms))


def dump(rows: DataFrame, key: str = "key") -> DataFrame:
    """CRDT.DUMP: each key's rows of all clocks as one JSON text, in their order; `merge` reads them back."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.to_json(F.sort_array(F.collect_set(F.struct(*rest)))).alias("payload"))


def merge(rows: DataFrame, payloads: DataFrame, key: str = "key") -> DataFrame:
    """CRDT.MERGE: rows with those of other replicas' dumps, once each; the aggregates above give the values."""
    rest = [f for f in rows.schema.fields if f.name != key]
    kind = "array<struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in rest) + ">>"
    arriving = payloads.select(key, F.inline(F.from_json("payload", kind)))
    return rows.unionByName(arriving.select(*rows.columns)).distinct()
