"""JSON, geo, sketches, replicated values, streams, agents and pub/sub over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import EARTH_RADIUS_M, geohash52, geohash52_point, geohash_text
from ..operators import agent, crdt, geo, jsonops, pubsub, sketches, streams
from ..sources.tables import table
from .registry import query

#: Milliseconds of a time without zone.
MILLIS_SQL = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"

# ---------------------------------------------------------------------------------------- JSON


def documents_of(s: SparkSession, d: str) -> DataFrame:
    """A JSON document per customer."""
    c = table(s, d, "customer")
    doc = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_custkey").alias("n"), F.struct(F.col("c_mktsegment").alias("segment")).alias("at"), F.array(F.lit("a"), F.col("c_mktsegment")).alias("tags"), (F.col("c_acctbal") > 0).alias("good")))
    return c.select(F.col("c_custkey").alias("key"), doc.alias("doc"))


@query("json_get", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", jsonops.get(F.col("props"), "$.k").cast("long").alias("k"))


@query("json_mget", "SELECT o_orderkey, c_mktsegment AS value FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def _(s, d):
    asked = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    return jsonops.get_many(documents_of(s, d), asked, "$.at.segment").select("o_orderkey", "value")


@query("json_type", "SELECT c_custkey AS key, 'string' AS t_name, 'integer' AS t_n, 'object' AS t_at, 'array' AS t_tags, 'boolean' AS t_good FROM customer")
def _(s, d):
    return documents_of(s, d).select("key", *(jsonops.kind(F.col("doc"), f"$.{p}").alias(f"t_{p}") for p in ("name", "n", "at", "tags", "good")))


@query("json_arrlen", "SELECT c_custkey AS key, 2 AS n, length(c_name) AS n_name FROM customer")
def _(s, d):
    doc = F.col("doc")
    return documents_of(s, d).select("key", jsonops.array_length(doc, "$.tags").alias("n"), jsonops.string_length(doc, "$.name").cast("long").alias("n_name"))


@query("json_objkeys", "SELECT c_custkey AS key, 'at,good,n,name,tags' AS names FROM customer")
def _(s, d):
    return documents_of(s, d).select("key", F.array_join(jsonops.object_keys(F.col("doc")), ",").alias("names"))


@query("json_numincrby", "SELECT c_custkey AS key, c_custkey + 5 AS n FROM customer")
def _(s, d):
    add = jsonops.edit("numincrby", "$.n")
    return documents_of(s, d).select("key", F.get_json_object(add(F.col("doc"), F.lit("5")), "$.n").cast("long").alias("n"))


@query("json_set_del", "SELECT c_custkey AS key, 'x' AS new, true AS gone FROM customer")
def _(s, d):
    made = jsonops.edit("set", "$.at.zone")(F.col("doc"), F.lit('"x"'))
    cut = jsonops.edit("del", "$.tags")(made, F.lit(None).cast("string"))
    return documents_of(s, d).select("key", F.get_json_object(cut, "$.at.zone").alias("new"), F.get_json_object(cut, "$.tags").isNull().alias("gone"))


@query("json_arr_toggle_clear", "SELECT c_custkey AS key, 3 AS n_tags, NOT (c_acctbal > 0) AS good, 0 AS n FROM customer")
def _(s, d):
    none = F.lit(None).cast("string")
    doc = jsonops.edit("arrappend", "$.tags")(F.col("doc"), F.lit('"z"'))
    doc = jsonops.edit("clear", "$.n")(jsonops.edit("toggle", "$.good")(doc, none), none)
    return documents_of(s, d).select("key", jsonops.array_length(doc, "$.tags").alias("n_tags"), (F.get_json_object(doc, "$.good") == "true").alias("good"), F.get_json_object(doc, "$.n").cast("int").alias("n"))


# ----------------------------------------------------------------------------------------- geo

PLACES = "places AS (SELECT 'c' AS key, c_custkey AS member, (c_custkey * 37 % 36000) / 100.0::DOUBLE - 180 AS lon, (c_custkey * 53 % 16000) / 100.0::DOUBLE - 80 AS lat FROM customer)"


def places(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(s, d, "customer").select(F.lit("c").alias("key"), k.alias("member"), ((k * 37 % 36000) / 100.0 - 180).alias("lon"), ((k * 53 % 16000) / 100.0 - 80).alias("lat"))


def metres(lon1: str, lat1: str, lon2: str = "lon", lat2: str = "lat") -> str:
    v = f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)"
    return f"(2 * {EARTH_RADIUS_M}::DOUBLE * asin(sqrt(least(1, {v}))))"


@query("geo_dist", f"WITH {PLACES} SELECT a.key, round({metres('a.lon', 'a.lat', 'b.lon', 'b.lat')} / 1000, 3) AS distance FROM places a JOIN places b USING (key) WHERE a.member = 1 AND b.member = 2")
def _(s, d):
    return geo.distance_between(places(s, d), 1, 2, "km").select("key", F.round("distance", 3).alias("distance"))


@query("geo_radius", f"WITH {PLACES} SELECT member, round({metres('10', '20')} / 1000, 3) AS distance FROM places WHERE {metres('10', '20')} <= 3000000")
def _(s, d):
    return geo.within_radius(places(s, d), 10.0, 20.0, 3000, "km").select("member", F.round("distance", 3).alias("distance"))


@query("geo_radius_dateline", f"WITH {PLACES} SELECT member, round({metres('179', '-10')} / 1000, 3) AS distance FROM places WHERE {metres('179', '-10')} <= 2500000")
def _(s, d):
    return geo.within_radius(places(s, d), 179.0, -10.0, 2500, "km").select("member", F.round("distance", 3).alias("distance"))


@query("geo_box", f"WITH {PLACES} SELECT member FROM places WHERE {metres('10', '20', '10', 'lat')} <= 1000000 AND {metres('10', 'lat', 'lon', 'lat')} <= 2000000")
def _(s, d):
    return geo.within_box(places(s, d), 10.0, 20.0, 4000, 2000, "km").select("member")


@query("geo_count_nearest", f"WITH {PLACES} SELECT member FROM places WHERE {metres('10', '20')} <= 5000000 ORDER BY {metres('10', '20')}, member LIMIT 5")
def _(s, d):
    return geo.closest(geo.within_radius(places(s, d), 10.0, 20.0, 5000, "km"), 5).select("member")


@query("geo_by_member", f"WITH {PLACES} SELECT b.member, round({metres('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 2) AS distance FROM places a JOIN places b USING (key) WHERE a.member = 5 AND {metres('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 2000000")
def _(s, d):
    return geo.around_member(places(s, d), 5, 2_000_000).select("member", F.round("distance", 2).alias("distance"))


@query("geo_encode", f"""WITH {PLACES}, c AS (SELECT member, CAST(floor((lat + 85.05112878) / 170.10225756 * 67108864) AS BIGINT) AS a, CAST(floor((lon + 180) / 360 * 67108864) AS BIGINT) AS o FROM places)
  SELECT member, CAST(list_sum(list_transform(range(26), lambda i: (((a >> i) & 1) << (2 * i)) + (((o >> i) & 1) << (2 * i + 1)))) AS BIGINT) AS cell FROM c""")
def _(s, d):
    return places(s, d).select("member", geohash52(F.col("lon"), F.col("lat")).alias("cell"))


@query("geo_decode", f"WITH {PLACES}, c AS (SELECT member, least(67108863, CAST(floor((lat + 85.05112878) / 170.10225756 * 67108864) AS BIGINT)) AS a, least(67108863, CAST(floor((lon + 180) / 360 * 67108864) AS BIGINT)) AS o FROM places) SELECT member, round((o + 0.5::DOUBLE) / 67108864 * 360 - 180, 9) AS lon, round((a + 0.5::DOUBLE) / 67108864 * 170.10225756 - 85.05112878, 9) AS lat FROM c")
def _(s, d):
    p = places(s, d).withColumn("at", geohash52_point(geohash52(F.col("lon"), F.col("lat"))))
    return p.select("member", F.round("at.lon", 9).alias("lon"), F.round("at.lat", 9).alias("lat"))


BASE32_SQL = "'0123456789bcdefghjkmnpqrstuvwxyz'"


@query("geo_hash32", f"""WITH {PLACES}, c AS (SELECT member, least(67108863, CAST(floor((lat + 85.05112878) / 170.10225756 * 67108864) AS BIGINT)) AS a, least(67108863, CAST(floor((lon + 180) / 360 * 67108864) AS BIGINT)) AS o FROM places),
  p AS (SELECT member, (a + 0.5::DOUBLE) / 67108864 * 170.10225756 - 85.05112878 AS lat, (o + 0.5::DOUBLE) / 67108864 * 360 - 180 AS lon FROM c),
  g AS (SELECT member, least(67108863, CAST(floor((lat + 90) / 180 * 67108864) AS BIGINT)) AS a, least(67108863, CAST(floor((lon + 180) / 360 * 67108864) AS BIGINT)) AS o FROM p),
  h AS (SELECT member, CAST(list_sum(list_transform(range(26), lambda i: (((a >> i) & 1) << (2 * i)) + (((o >> i) & 1) << (2 * i + 1)))) AS BIGINT) AS code FROM g)
  SELECT member, array_to_string(list_transform(range(10), lambda i: substr({BASE32_SQL}, CAST(((code >> CAST(47 - 5 * i AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') || '0' AS geohash FROM h""")
def _(s, d):
    return places(s, d).select("member", geohash_text(F.col("lon"), F.col("lat")).alias("geohash"))


# ------------------------------------------------------------------------------------ sketches


def typed(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("item"))


@query("pfcount_exact_bound", "SELECT event_type AS key, true AS close FROM events GROUP BY 1")
def _(s, d):
    found = sketches.distinct_sketch(typed(s, d), "item").select("key", F.hll_sketch_estimate("sketch").alias("estimate"))
    exact = typed(s, d).groupBy("key").agg(F.countDistinct("item").alias("n"))
    return found.join(exact, "key").select("key", (F.abs(F.col("estimate") - F.col("n")) <= 0.03 * F.col("n") + 1).alias("close"))


@query("pfmerge_union", "SELECT true AS close")
def _(s, d):
    merged = sketches.merge_sketches(sketches.distinct_sketch(typed(s, d), "item")).withColumn("one", F.lit(1))
    exact = typed(s, d).agg(F.countDistinct("item").alias("n")).withColumn("one", F.lit(1))
    return merged.join(exact, "one").select((F.abs(F.col("estimate") - F.col("n")) <= 0.03 * F.col("n") + 1).alias("close"))


@query("bloom_no_false_negative", "SELECT event_type AS key, count(DISTINCT user_id) AS n, count(DISTINCT user_id) AS n_found FROM events GROUP BY 1")
def _(s, d):
    rows = typed(s, d)
    bits, hashes = sketches.bloom_size(1000, 0.01)
    found = sketches.bloom_contains(sketches.bloom(rows, "item", bits, hashes), rows, "item", bits, hashes)
    return found.groupBy("key").agg(F.count("*").alias("n"), F.count_if("found").alias("n_found"))


@query("bloom_false_positives", "SELECT event_type AS key, count(DISTINCT user_id) AS n, true AS rare FROM events GROUP BY 1")
def _(s, d):
    rows = typed(s, d)
    bits, hashes = sketches.bloom_size(1000, 0.01)
    strangers = rows.select("key").distinct().withColumn("item", F.explode(F.sequence(F.lit(-2000).cast("long"), F.lit(-1).cast("long"))))
    found = sketches.bloom_contains(sketches.bloom(rows, "item", bits, hashes), rows.select("key", "item").union(strangers), "item", bits, hashes)
    sums = found.groupBy("key").agg(F.count_if(F.col("found") & (F.col("item") >= 0)).alias("n"), F.count_if(F.col("found") & (F.col("item") < 0)).alias("wrong"), F.count_if(F.col("item") >= 0).alias("held"))
    # at its capacity the filter is wrong once in 100; twice that leaves room for chance, and a filter of more items may be wrong more often
    return sums.select("key", "n", ((F.col("wrong") <= 0.02 * 2000) | (F.col("held") > 1000)).alias("rare"))


@query("cuckoo_delete", "SELECT event_type AS key, count(DISTINCT user_id) AS n, count(DISTINCT CASE WHEN user_id % 2 = 0 THEN user_id END) AS n_held FROM events GROUP BY 1")
def _(s, d):
    items = typed(s, d).distinct()
    log = items.withColumn("delta", F.lit(1)).unionByName(items.where("item % 2 = 1").withColumn("delta", F.lit(-1)))
    found = sketches.cuckoo_contains(sketches.cuckoo(log), items)
    return found.groupBy("key").agg(F.count("*").alias("n"), F.count_if("found").alias("n_held"))


@query("cms_estimate_ge_true", "SELECT event_type AS key, true AS bounded FROM events GROUP BY 1")
def _(s, d):
    rows = typed(s, d)
    width, depth = sketches.cms_size(0.001, 0.99)
    cells = sketches.cms(rows, "item", F.lit(1), width, depth)
    exact = rows.groupBy("key", "item").agg(F.count("*").alias("n"))
    asked = sketches.cms_query(cells, rows, "item", width, depth).join(exact, ["key", "item"])
    return asked.groupBy("key").agg(F.every(F.col("estimate") >= F.col("n")).alias("bounded"))


@query("topk_exact", "WITH c AS (SELECT event_type AS key, user_id AS item, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, item) AS place FROM c) SELECT key, item, n, place FROM r WHERE place <= 5")
def _(s, d):
    return sketches.top_k(typed(s, d), "item", 5).withColumn("place", F.col("place").cast("long"))


# ------------------------------------------------------------------------------ replicated values

CR = "c AS (SELECT user_id AS key, event_type AS value, event_type = 'error' AS deleted, (epoch_us(ts) // 1000) AS physical_ms, 0 AS logical, event_id % 3 AS node, event_id FROM events)"


def replicas(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), (F.col("event_type") == "error").alias("deleted"), F.expr(MILLIS_SQL).alias("physical_ms"), F.col("event_id").alias("logical"), (F.col("event_id") % 3).alias("node"))


@query("crdt_lww", f"WITH {CR}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY physical_ms DESC, event_id DESC) AS k FROM c) SELECT key, value FROM r WHERE k = 1 AND NOT deleted")
def _(s, d):
    return crdt.last_writer(replicas(s, d))


@query("crdt_pn_counter", "WITH n AS (SELECT user_id AS key, event_id % 3 AS node, count(*) FILTER (event_type <> 'error') AS p, count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY 1, 2) SELECT key, CAST(sum(p) - sum(n) AS BIGINT) AS value FROM n GROUP BY key")
def _(s, d):
    rows = replicas(s, d).groupBy("key", "node").agg(F.count_if(~F.col("deleted")).alias("p"), F.count_if("deleted").alias("n"))
    return crdt.counter(rows.unionByName(rows.withColumn("p", F.col("p") - 1)))  # an older state of each node joins the merge


@query("crdt_orset", "SELECT DISTINCT user_id AS key, event_type AS member FROM events WHERE event_id % 5 <> 0")
def _(s, d):
    rows = table(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("member"), F.col("event_id").alias("tag"))
    return crdt.observed_set(rows, rows.where("tag % 5 = 0"))


@query("crdt_gc", "SELECT count(*) AS n FROM events WHERE event_type <> 'error' OR (epoch_us(ts) // 1000) >= (SELECT (epoch_us(min(ts)) // 1000) + 86400000 FROM events)")
def _(s, d):
    rows = replicas(s, d)
    start = rows.agg(F.min("physical_ms")).first()[0] or 0
    return crdt.collect_garbage(rows, start + 86_400_000).agg(F.count("*").alias("n"))


# -------------------------------------------------------------------------------------- streams

X = "x AS (SELECT event_type AS key, (epoch_us(ts) // 1000) AS ms, event_id AS seq, user_id FROM events)"


def entries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("event_type").alias("key"), F.expr(MILLIS_SQL).alias("ms"), F.col("event_id").alias("seq"), "user_id")


def span(s: SparkSession, d: str) -> tuple[int, int]:
    r = entries(s, d).agg(F.min("ms"), F.max("ms")).first()
    return r[0], r[1]


SPAN = "(SELECT (epoch_us(min(ts)) // 1000) FROM events)"
END = "(SELECT (epoch_us(max(ts)) // 1000) FROM events)"


@query("x_range", f"WITH {X} SELECT key, ms, seq FROM x WHERE ms BETWEEN {SPAN} + 86400000 AND {SPAN} + 172800000")
def _(s, d):
    a, _ = span(s, d)
    return streams.entry_range(entries(s, d), (a + 86_400_000, 0), (a + 172_800_000, 1 << 62)).select("key", "ms", "seq")


@query("x_revrange", f"WITH {X} SELECT key, ms, seq FROM x WHERE key = 'click' ORDER BY ms DESC, seq DESC LIMIT 7")
def _(s, d):
    return streams.entry_range(entries(s, d).where("key = 'click'"), (0, 0), (1 << 61, 1 << 61), 7, reverse=True).select("key", "ms", "seq")


@query("x_len", f"WITH {X} SELECT key, count(*) AS n FROM x GROUP BY key")
def _(s, d):
    return entries(s, d).groupBy("key").agg(F.count("*").alias("n"))


@query("x_trim_maxlen", f"WITH {X}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS k FROM x) SELECT key, ms, seq FROM r WHERE k <= 20")
def _(s, d):
    return streams.trim_to_length(entries(s, d), 20).select("key", "ms", "seq")


@query("x_trim_minid", f"WITH {X} SELECT key, ms, seq FROM x WHERE ms >= {END} - 86400000")
def _(s, d):
    return streams.trim_to_id(entries(s, d), span(s, d)[1] - 86_400_000).select("key", "ms", "seq")


@query("x_read_after", f"WITH {X}, l AS (SELECT key, arg_min(ms, ms) AS last_ms FROM x GROUP BY key), r AS (SELECT x.*, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS k FROM x JOIN l USING (key) WHERE ms > last_ms) SELECT key, ms, seq FROM r WHERE k <= 3")
def _(s, d):
    e = entries(s, d)
    last = e.groupBy("key").agg(F.min("ms").alias("last_ms")).withColumn("last_seq", F.lit((1 << 62)))
    return streams.read_after(e, last, 3).select("key", "ms", "seq")


@query("x_add_increasing", f"WITH {X}, r AS (SELECT *, max(ms) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM x) SELECT key, ms, seq FROM r WHERE top IS NULL OR ms >= top")
def _(s, d):
    return streams.accepted(entries(s, d), "seq").select("key", "ms", "seq")


def pending(s: SparkSession, d: str) -> DataFrame:
    """A group of three consumers; by user, so that SQL can follow."""
    return entries(s, d).select("key", "ms", "seq", F.concat(F.lit("c"), F.col("user_id") % 3).alias("consumer"), F.col("ms").alias("delivery_ms"), F.lit(1).alias("delivery_count"))


P = f"{X}, p AS (SELECT key, ms, seq, 'c' || (user_id % 3) AS consumer, ms AS delivery_ms, 1 AS delivery_count FROM x)"


@query("x_group_deliver", f"WITH {X} SELECT key, 'consumer' || (CAST('0x' || substr(md5(ms || '-' || seq), 1, 8) AS BIGINT) % 3) AS consumer, count(*) AS n FROM x GROUP BY 1, 2")
def _(s, d):
    return streams.deliver(entries(s, d), 3, F.col("ms")).groupBy("key", "consumer").agg(F.count("*").alias("n"))


@query("x_pending_summary", f"WITH {P} SELECT key, consumer, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms FROM p GROUP BY ALL")
def _(s, d):
    return streams.pending_summary(pending(s, d)).select("key", "consumer", "n", "first_ms", "last_ms")


@query("x_ack", f"WITH {P} SELECT key, consumer, count(*) AS n FROM p WHERE seq % 3 <> 0 GROUP BY ALL")
def _(s, d):
    rows = pending(s, d)
    return streams.acknowledge(rows, rows.where("seq % 3 = 0").select("key", "ms", "seq")).groupBy("key", "consumer").agg(F.count("*").alias("n"))


@query("x_claim_idle", f"WITH {P} SELECT consumer, count(*) AS n, CAST(sum(delivery_count) AS BIGINT) AS deliveries FROM (SELECT CASE WHEN {END} - delivery_ms >= 864000000 THEN 'worker' ELSE consumer END AS consumer, delivery_count + CASE WHEN {END} - delivery_ms >= 864000000 THEN 1 ELSE 0 END AS delivery_count FROM p) GROUP BY 1")
def _(s, d):
    rows = streams.claim(pending(s, d), "worker", span(s, d)[1], 864_000_000)
    return rows.groupBy("consumer").agg(F.count("*").alias("n"), F.sum("delivery_count").alias("deliveries"))


@query("x_autoclaim_page", f"WITH {P}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS k FROM p WHERE {END} - delivery_ms >= 864000000) SELECT key, ms, seq FROM r WHERE k <= 5")
def _(s, d):
    return streams.claim(pending(s, d), "worker", span(s, d)[1], 864_000_000, count=5).where("claimed").select("key", "ms", "seq")


@query("x_idmp_dedup", "WITH RECURSIVE e AS (SELECT event_type AS key, user_id AS u, event_id AS seq, (epoch_us(ts) // 1000) AS ms, row_number() OVER (PARTITION BY event_type, user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS i FROM events), w AS (SELECT key, u, seq, ms, i, true AS took, ms + 3600000 AS until FROM e WHERE i = 1 UNION ALL SELECT e.key, e.u, e.seq, e.ms, e.i, e.ms >= w.until, CASE WHEN e.ms >= w.until THEN e.ms + 3600000 ELSE w.until END FROM e JOIN w ON e.key = w.key AND e.u = w.u AND e.i = w.i + 1) SELECT key, ms, seq FROM w WHERE took")
def _(s, d):
    rows = entries(s, d).withColumn("producer", F.col("user_id")).withColumn("token", F.lit(1))
    return streams.idempotent(rows, window_ms=3_600_000).select("key", "ms", "seq")


# --------------------------------------------------------------------------------------- agents

T = "t AS (SELECT DISTINCT conv_id AS session, turn, text AS content, greatest(1, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT)) AS tokens FROM conversations)"


def session_turns(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations").select(F.col("conv_id").alias("session"), "turn", F.col("text").alias("content")).distinct()
    return c.withColumn("tokens", agent.token_estimate(F.col("content")))


@query("agent_context_window", f"WITH {T}, u AS (SELECT *, sum(tokens) OVER (PARTITION BY session ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM t) SELECT session, turn, CAST(used AS BIGINT) AS used FROM u WHERE used <= 120")
def _(s, d):
    return agent.context_window(session_turns(s, d), 120).select("session", "turn", "used")


@query("agent_compact", f"WITH {T}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn DESC) > 2 AS old FROM t), a AS (SELECT session, count(*) FILTER (old) AS compacted, count(*) FILTER (NOT old) AS n, coalesce(sum(tokens) FILTER (NOT old), 0) AS k FROM r GROUP BY 1) SELECT session, compacted, n + CASE WHEN compacted > 0 THEN 1 ELSE 0 END AS active, CAST(k + CASE WHEN compacted > 0 THEN 4 ELSE 0 END AS BIGINT) AS active_tokens FROM a")
def _(s, d):
    return agent.compact(session_turns(s, d), 2, F.lit("a short summary"))


@query("agent_recall", "WITH v AS (SELECT label AS session, vec_id AS turn, embedding::DOUBLE[] AS x FROM embeddings), q AS (SELECT x AS qv FROM v WHERE turn = 0), old AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn DESC) AS k FROM v), c AS (SELECT session, turn, greatest(1 - list_sum(list_transform(list_zip(x, qv), lambda p: p[1] * p[2])) / sqrt(list_sum(list_transform(x, lambda a: a * a)) * list_sum(list_transform(qv, lambda a: a * a))), 0) AS dist FROM old, q WHERE k > 3), r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY dist, turn) AS place FROM c) SELECT session, turn, place FROM r WHERE place <= 2")
def _(s, d):
    turns = table(s, d, "embeddings").select(F.col("label").alias("session"), F.col("vec_id").alias("turn"), "embedding", F.lit(40).alias("tokens"))
    first = turns.where("turn = 0").first()["embedding"]
    found = agent.recall(turns, agent.context_window(turns, 120), F.array(*(F.lit(float(x)) for x in first)), 2)
    return found.select("session", "turn", F.col("place").cast("long").alias("place"))


@query("agent_checkpoint_history", "WITH RECURSIVE s AS (SELECT o_orderkey AS id, o_orderkey // 2 AS parent FROM orders WHERE o_orderkey >= 1), w AS (SELECT id, parent, 0 AS depth FROM s WHERE id = 500 UNION ALL SELECT s.id, s.parent, w.depth + 1 FROM s JOIN w ON s.id = w.parent WHERE w.depth < 49) SELECT CAST(id AS VARCHAR) AS step_id, depth FROM w")
def _(s, d):
    steps = table(s, d, "orders").where("o_orderkey >= 1").select(F.col("o_orderkey").cast("string").alias("step_id"), F.floor(F.col("o_orderkey") / 2).cast("string").alias("parent_id"))
    return agent.lineage(s, steps, "500").select("step_id", "depth")


@query("llm_quota_sliding", "SELECT event_id, count(*) OVER w AS requests, CAST(sum(user_id) OVER w AS BIGINT) AS window_tokens FROM events WINDOW w AS (PARTITION BY event_type ORDER BY (epoch_us(ts) // 1000) RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW)")
def _(s, d):
    calls = table(s, d, "events").select("event_id", F.col("event_type").alias("key"), F.expr(MILLIS_SQL).alias("ts_ms"), F.col("user_id").alias("tokens"))
    return agent.quota_pressure(calls, 3_600_000).select("event_id", "requests", "window_tokens")


@query("tool_claim_replay", "WITH RECURSIVE e AS (SELECT user_id AS k, event_id, (epoch_us(ts) // 1000) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS i FROM events), w AS (SELECT k, event_id, i, true AS granted, ms + 60000 AS until FROM e WHERE i = 1 UNION ALL SELECT e.k, e.event_id, e.i, e.ms >= w.until, CASE WHEN e.ms >= w.until THEN e.ms + 60000 ELSE w.until END FROM e JOIN w ON e.k = w.k AND e.i = w.i + 1) SELECT event_id, granted FROM w")
def _(s, d):
    calls = table(s, d, "events").select("event_id", F.col("user_id").alias("call_id"), F.struct(F.expr(MILLIS_SQL).alias("ms"), "event_id").alias("at"), F.expr(MILLIS_SQL).alias("ts_ms"))
    return agent.tool_claims(calls, 60_000, "call_id", "ts_ms", "event_id").select("event_id", "granted")


# -------------------------------------------------------------------------------------- pub/sub


def messages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("event_type").alias("channel"), F.col("props").alias("payload"), "ts", "event_id")


@query("pubsub_channel_counts", "SELECT event_type AS channel, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    return pubsub.channel_counts(messages(s, d))


@query("pubsub_pattern_match", "SELECT event_id, event_type AS channel FROM events WHERE event_type = 'view' OR regexp_full_match(event_type, 'c.*k')")
def _(s, d):
    return pubsub.subscribed(messages(s, d), ["view"], ["c*k"]).select("event_id", "channel")
