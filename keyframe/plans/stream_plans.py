"""Structured Streaming over the events table: a file source, read to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import processors
from ..operators import pubsub
from ..sources.tables import append, compact, load_snapshot, replay, save_snapshot, shared_dir, table
from .data_plans import MILLIS_SQL
from .registry import query


def events(s: SparkSession, d: str) -> DataFrame:
    schema = s.read.parquet(f"{d}/events.parquet").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what there is and return its rows. State is kept in RocksDB, which keyed processors need."""
    s = stream.sparkSession
    at = f"{shared_dir(s)}/keyframe/stream-{uuid.uuid4().hex}"
    before = s.conf.get(PROVIDER)
    s.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        s.conf.set(PROVIDER, before)
    return s.read.schema(stream.schema).parquet(f"{at}/out")


@query("stream_increasing_ids", "WITH x AS (SELECT event_type, event_id, epoch_us(ts) // 1000 AS ms FROM events), r AS (SELECT *, max(ms) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM x) SELECT event_type AS key, count(*) AS n FROM r WHERE top IS NULL OR ms >= top GROUP BY 1")
def _(s, d):
    rows = events(s, d).select(F.col("event_type").alias("key"), F.expr(MILLIS_SQL).alias("ms"), F.col("event_id").alias("seq"))
    at = f"{shared_dir(s)}/keyframe/stream-{uuid.uuid4().hex}"

    def fold(batch: DataFrame, number: int) -> None:
        """The entries that a micro-batch takes in, of what arrived in the order of event_id."""
        old = batch.sparkSession.read.parquet(f"{at}/tops-{number - 1}") if number else None
        kept, tops = processors.above_all_before(batch, old, "key", "ms", "seq", "seq")
        kept.write.mode("overwrite").parquet(f"{at}/out/batch={number}")
        tops.write.mode("overwrite").parquet(f"{at}/tops-{number}")

    rows.writeStream.foreachBatch(fold).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(rows.schema).parquet(f"{at}/out").groupBy("key").agg(F.count("*").alias("n"))


@query("stream_tool_leases", "WITH RECURSIVE e AS (SELECT user_id AS k, event_id, (epoch_us(ts) // 1000) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS i FROM events), w AS (SELECT k, event_id, i, true AS granted, ms + 60000 AS until FROM e WHERE i = 1 UNION ALL SELECT e.k, e.event_id, e.i, e.ms >= w.until, CASE WHEN e.ms >= w.until THEN e.ms + 60000 ELSE w.until END FROM e JOIN w ON e.k = w.k AND e.i = w.i + 1) SELECT k AS call_id, event_id AS claim_id, granted FROM w")
def _(s, d):
    rows = events(s, d).select(F.col("user_id").alias("call_id"), F.col("event_id").alias("claim_id"), F.expr(MILLIS_SQL).alias("ts_ms"))
    return to_end(processors.tool_leases(rows, 60_000))


@query("stream_dedup", "SELECT count(DISTINCT event_id) AS n FROM events")
def _(s, d):
    rows = events(s, d).select("event_id", F.col("ts").cast("timestamp").alias("at"))
    return to_end(processors.deduplicated(rows, ["event_id"], "at", "1 hour")).agg(F.count("*").alias("n"))


@query("stream_blpop", "WITH x AS (SELECT user_id AS g, event_id, event_type, CASE WHEN event_type IN ('click', 'view') THEN 'pop' ELSE 'push' END AS side FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY g, side ORDER BY event_id) AS n FROM x) SELECT CAST(a.g AS VARCHAR) AS \"group\", CAST(a.event_id AS VARCHAR) AS client, CAST(b.event_id AS VARCHAR) AS value FROM n a JOIN n b ON a.g = b.g AND a.n = b.n AND a.side = 'pop' AND b.side = 'push'")
def _(s, d):
    waits = F.col("event_type").isin("click", "view")
    rows = events(s, d).select(
        F.col("user_id").cast("string").alias("group"), F.col("event_id").alias("seq"), F.when(waits, "left").otherwise("rpush").alias("kind"), F.lit("list").alias("key"), F.col("event_id").cast("string").alias("value"),
        F.lit(None).cast("double").alias("score"), F.col("event_id").cast("string").alias("client"), F.array(F.lit("none"), F.lit("list")).alias("keys"), F.lit(1).alias("count"), F.lit(None).cast("string").alias("target"),
    )
    return to_end(processors.blocking_store(rows)).select("group", "client", "value")


@query("stream_bzpopmin")
def _(s, d):
    waits = F.col("event_type").isin("click", "view")
    rows = events(s, d).select(
        F.col("user_id").cast("string").alias("group"), F.col("event_id").alias("seq"), F.when(waits, "min").otherwise("zadd").alias("kind"), F.lit("z").alias("key"), F.col("event_id").cast("string").alias("value"),
        F.col("value").alias("score"), F.col("event_id").cast("string").alias("client"), F.array(F.lit("z")).alias("keys"), F.lit(1).alias("count"), F.lit(None).cast("string").alias("target"),
    )
    return to_end(processors.blocking_store(rows)).select("group", "client", "value", "score")


@query("stream_publish", "SELECT event_id, event_type AS channel FROM events WHERE event_type = 'view' OR regexp_full_match(event_type, 'c.*k')")
def _(s, d):
    rows = events(s, d).select(F.col("event_type").alias("channel"), "event_id")
    return to_end(pubsub.subscribed(rows, ["view"], ["c*k"]).select("event_id", "channel"))


@query("pubsub_sharded", "SELECT event_id, event_type AS channel, CAST('0x' || substr(md5(event_type), 1, 8) AS BIGINT) % 4 AS shard FROM events WHERE event_type IN ('view', 'click')")
def _(s, d):
    rows = s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("channel"), "event_id")
    return pubsub.sharded(rows, ["view", "click"], 4).select("event_id", "channel", "shard")


@query("snapshot_save_load", "SELECT c_custkey, c_name, 'customer' AS part FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def _(s, d):
    at = f"{shared_dir(s)}/keyframe/snapshot-{uuid.uuid4().hex}"
    save_snapshot({name: table(s, d, name) for name in ("customer", "supplier")}, at)
    loaded = load_snapshot(s, at, ["customer", "supplier"])
    both = loaded["customer"].select("c_custkey", "c_name", F.lit("customer").alias("part"))
    return both.union(loaded["supplier"].select("s_suppkey", "s_name", F.lit("supplier")))


@query("log_append_replay", "WITH l AS (SELECT user_id AS key, event_id AS seq, event_type AS value FROM events) SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM l GROUP BY key HAVING arg_max(value, seq) <> 'error'")
def _(s, d):
    at = f"{shared_dir(s)}/keyframe/log-{uuid.uuid4().hex}"
    rows = table(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "del").otherwise("set").alias("op"), F.col("event_type").alias("value"))
    for k in range(3):
        append(rows.where(F.col("seq") % 3 == k), f"{at}/log")

    def fold(batch: DataFrame, number: int) -> None:
        """The latest write of each key so far, deletes with it, as the next version of the state."""
        old = [batch.sparkSession.read.parquet(f"{at}/state-{number - 1}")] if number else []
        both = batch.unionByName(old[0]) if old else batch
        compact(both, ["key"], op=None).select(*batch.columns).write.mode("overwrite").parquet(f"{at}/state-{number}")

    query_ = replay(s, f"{at}/log", rows.schema, fold, f"{at}/checkpoint")
    query_.awaitTermination()
    last = max(p["batchId"] for p in query_.recentProgress)
    return s.read.parquet(f"{at}/state-{last}").where("op <> 'del'").select("key", "seq", "value")
