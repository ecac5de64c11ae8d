"""Strings, bitmaps, hashes, lists, sets, sorted sets and keys over the driver's tables.

events is the mutation log of a store whose keys are users (seq = event_id); parts by
supplier are sets; orders by priority are sorted sets; turns of a conversation are lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import byte_range, overwrite
from ..operators import bitmaps, hashes, keyspace, lists, sets, strings, zsets
from ..sources.tables import compact, table
from .registry import query

AS_OF = 1_710_000_000_000  # a fixed clock (ms), so that reruns agree


def log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"), F.col("value").cast("long").alias("delta"))


LOG = "log AS (SELECT user_id AS key, event_id AS seq, event_type AS value, CAST(trunc(value) AS BIGINT) AS delta FROM events)"


@query("str_set_latest", f"WITH {LOG} SELECT key, arg_max(value, seq) AS value FROM log GROUP BY key")
def _(s, d):
    return strings.latest(log(s, d))


@query("str_setnx", f"WITH {LOG} SELECT key, arg_min(value, seq) AS value FROM log GROUP BY key")
def _(s, d):
    return strings.set_if_absent(log(s, d))


@query("str_msetnx", f"WITH {LOG}, store AS (SELECT DISTINCT key FROM log WHERE key % 2 = 0), new AS (SELECT key, arg_max(value, seq) AS value FROM log WHERE key % 2 = 1 GROUP BY key) SELECT key, value FROM new WHERE NOT EXISTS (SELECT 1 FROM new n JOIN store USING (key))")
def _(s, d):
    rows = log(s, d)
    return strings.set_all_if_absent(strings.latest(rows.where("key % 2 = 1")), rows.where("key % 2 = 0").select("key").distinct())


@query("str_mget", f"WITH {LOG}, store AS (SELECT key, arg_max(value, seq) AS value FROM log GROUP BY key) SELECT c_custkey AS key, value FROM customer LEFT JOIN store ON key = c_custkey")
def _(s, d):
    keys = table(s, d, "customer").select(F.col("c_custkey").alias("key"))
    return strings.get_many(strings.latest(log(s, d)), keys)


@query("str_getset", f"WITH {LOG} SELECT key, seq, value, lag(value) OVER (PARTITION BY key ORDER BY seq) AS old FROM log")
def _(s, d):
    return strings.previous(log(s, d)).select("key", "seq", "value", "old")


@query("str_incr_sum", f"WITH {LOG} SELECT key, CAST(sum(delta) AS BIGINT) AS value FROM log GROUP BY key")
def _(s, d):
    return strings.increment(log(s, d))


@query("str_append_fold", f"WITH {LOG} SELECT key, string_agg(substr(value, 1, 1), '' ORDER BY seq) AS value FROM log GROUP BY key")
def _(s, d):
    return strings.append(log(s, d).withColumn("value", F.substring("value", 1, 1)))


@query("str_strlen", "SELECT doc_id, CAST(octet_length(encode(text)) AS INTEGER) AS n_bytes FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.octet_length("text").alias("n_bytes"))


@query("str_getrange", "SELECT c_custkey, substr(c_name, 3, 4) AS head, CASE WHEN length(c_name) > 2 THEN right(c_name, 3) ELSE c_name END AS tail FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", byte_range(F.col("c_name"), 2, 5).alias("head"), byte_range(F.col("c_name"), -3, -1).alias("tail"))


@query("str_setrange", "SELECT c_custkey, substr(c_name, 1, 2) || '##' || substr(c_name, 5) AS value FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", overwrite(F.col("c_name"), 2, "##").alias("value"))


@query("str_increx_bounds", f"""WITH RECURSIVE {LOG}, n AS (SELECT key, delta, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM log),
  w AS (SELECT key, i, least(150, greatest(0, delta)) AS value, least(150, greatest(0, delta)) AS applied FROM n WHERE i = 1
    UNION ALL SELECT n.key, n.i, least(150, greatest(0, w.value + CASE WHEN n.i % 2 = 0 THEN -n.delta ELSE n.delta END)), least(150, greatest(0, w.value + CASE WHEN n.i % 2 = 0 THEN -n.delta ELSE n.delta END)) - w.value FROM n JOIN w ON n.key = w.key AND n.i = w.i + 1)
  SELECT key, arg_max(value, i) AS value, arg_max(applied, i) AS applied FROM w GROUP BY key""")
def _(s, d):
    from pyspark.sql import Window

    rows = log(s, d).withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("seq")))
    rows = rows.withColumn("delta", F.when(F.col("i") % 2 == 0, -F.col("delta")).otherwise(F.col("delta")))
    return strings.bounded_increments(rows, 0, 150)


@query("str_lcs")
def _(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", strings.longest_common_subsequence(F.col("p_name"), F.col("p_type")).alias("lcs"))


@query("str_delifeq", f"WITH {LOG}, store AS (SELECT key, arg_max(value, seq) AS value FROM log GROUP BY key) SELECT key, value FROM store WHERE value <> 'click' OR key % 2 = 1")
def _(s, d):
    store = strings.latest(log(s, d))
    return strings.delete_if_equal(store, store.where("key % 2 = 0").select("key", F.lit("click").alias("value")))


@query("str_digest", f"WITH {LOG}, store AS (SELECT key, arg_max(value, seq) AS value FROM log GROUP BY key) SELECT key, value, substr(md5(value), 1, 16) AS digest FROM store")
def _(s, d):
    return strings.digest(strings.latest(log(s, d)))


@query("log_compaction", f"WITH {LOG}, last AS (SELECT key, max(seq) AS seq FROM log GROUP BY key) SELECT key, seq, value FROM log JOIN last USING (key, seq) WHERE value <> 'error'")
def _(s, d):
    rows = log(s, d).withColumn("op", F.when(F.col("value") == "error", "del").otherwise("set"))
    return compact(rows.select("key", "seq", "value", "op"), ["key"]).select("key", "seq", "value")


# ---------------------------------------------------------------------- bitmaps: a bit per day of activity

BITS = "bits AS (SELECT DISTINCT event_type AS key, (event_id % 100000) * (event_id % 100000) % (length(event_type) * 97) AS \"offset\" FROM events)"


def bits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("key"), ((F.col("event_id") % 100_000) * (F.col("event_id") % 100_000) % (F.length("event_type") * 97)).alias("offset")).distinct()


@query("bit_count", f'WITH {BITS} SELECT key, count(*) AS n_bits FROM bits WHERE "offset" BETWEEN 8 AND 79 GROUP BY key')
def _(s, d):
    return bitmaps.count(bits(s, d), 1, 9)


@query("bit_op_and", f'WITH {BITS} SELECT "offset" FROM bits WHERE key IN (\'click\', \'view\') GROUP BY "offset" HAVING count(*) = 2')
def _(s, d):
    return bitmaps.combine(bits(s, d), "and", keys=["click", "view"])


@query("bit_op_xor", f'WITH {BITS} SELECT "offset" FROM bits WHERE key IN (\'click\', \'view\', \'purchase\') GROUP BY "offset" HAVING count(*) % 2 = 1')
def _(s, d):
    return bitmaps.combine(bits(s, d), "xor", keys=["click", "view", "purchase"])


@query("bit_op_diff", f'WITH {BITS} SELECT "offset" FROM bits WHERE key = \'click\' AND "offset" NOT IN (SELECT "offset" FROM bits WHERE key = \'view\')')
def _(s, d):
    return bitmaps.combine(bits(s, d), "diff", keys=["click", "view"])


@query("bit_op_not", f"""WITH {BITS}, sizes AS (SELECT key, CAST(max("offset") // 8 + 1 AS BIGINT) AS n FROM bits GROUP BY key), every AS (SELECT key, unnest(range(n * 8)) AS "offset" FROM sizes) SELECT key, "offset" FROM every EXCEPT SELECT key, "offset" FROM bits""")
def _(s, d):
    rows = bits(s, d)
    return bitmaps.invert(rows, rows.groupBy("key").agg((F.floor(F.max("offset") / 8) + 1).alias("n_bytes")))


@query("bit_pos", f"""WITH {BITS}, one AS (SELECT key, min("offset") AS first_one FROM bits GROUP BY key), r AS (SELECT key, "offset", row_number() OVER (PARTITION BY key ORDER BY "offset") - 1 AS p FROM bits), zero AS (SELECT key, max("offset") + 1 AS z FROM r WHERE p = "offset" GROUP BY key) SELECT key, first_one, CAST(coalesce(z, 0) AS BIGINT) AS first_zero FROM one LEFT JOIN zero USING (key)""")
def _(s, d):
    rows = bits(s, d)
    return bitmaps.first_bit(rows, 1).withColumnRenamed("position", "first_one").join(bitmaps.first_bit(rows, 0).select("key", F.col("position").cast("long").alias("first_zero")), "key")


@query("bitfield_wrap_sat", f"WITH {LOG} SELECT key, seq, CAST((((delta * 7 + 128) % 256 + 256) % 256) - 128 AS BIGINT) AS wrapped, CAST(least(127, greatest(-128, delta * 7)) AS BIGINT) AS saturated, CASE WHEN delta * 7 BETWEEN -128 AND 127 THEN CAST(delta * 7 AS BIGINT) END AS failed FROM log")
def _(s, d):
    step = F.col("delta") * 7
    zero = F.lit(0)
    return log(s, d).select("key", "seq", *(bitmaps.field_increment(zero, step, 8, True, mode).alias(name) for mode, name in (("wrap", "wrapped"), ("sat", "saturated"), ("fail", "failed"))))


# ----------------------------------------------------------------------- hashes: event types of a user

FIELDS = "fields AS (SELECT user_id AS key, event_type AS field, arg_max(event_id, event_id) AS value FROM events GROUP BY 1, 2)"


def fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("field"), F.col("event_id").alias("value"))
    return hashes.set_fields(rows.withColumn("seq", F.col("value")))


@query("hash_hget_latest", f"WITH {FIELDS} SELECT * FROM fields")
def _(s, d):
    return fields(s, d)


@query("hash_hmget", f"WITH {FIELDS} SELECT c_custkey AS key, 'click' AS field, value FROM customer LEFT JOIN fields ON key = c_custkey AND field = 'click'")
def _(s, d):
    asked = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("click").alias("field"))
    return hashes.get_fields(fields(s, d), asked)


@query("hash_hincrby", "SELECT user_id AS key, event_type AS field, CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) AS value FROM events GROUP BY 1, 2")
def _(s, d):
    rows = table(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("field"), F.col("value").cast("long").alias("delta"))
    return hashes.increment_fields(rows)


@query("hash_hgetall", f"WITH {FIELDS} SELECT key, string_agg(field || '=' || value, ',' ORDER BY field) AS fields FROM fields GROUP BY key")
def _(s, d):
    maps = hashes.as_map(fields(s, d))
    return maps.select("key", F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("fields"))


@query("hash_hlen_hkeys", f"WITH {FIELDS} SELECT key, count(*) AS n_fields, string_agg(field, ',' ORDER BY field) AS keys FROM fields GROUP BY key")
def _(s, d):
    return hashes.shape(fields(s, d)).select("key", "n_fields", F.array_join("keys", ",").alias("keys"))


@query("hash_hsetnx", f"WITH {FIELDS} SELECT key, field, value FROM fields UNION ALL SELECT c_custkey, 'joined', 0 FROM customer")
def _(s, d):
    new = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("joined").alias("field"), F.lit(0).cast("long").alias("value"))
    return hashes.set_fields_if_absent(new, fields(s, d))


@query("hash_hdel", f"WITH {FIELDS} SELECT key, field, value FROM fields WHERE field <> 'view'")
def _(s, d):
    store = fields(s, d)
    return hashes.delete_fields(store, store.where("field = 'view'").select("key", "field"))


@query("hash_field_ttl", f"WITH {FIELDS}, e AS (SELECT key, field, CASE WHEN value % 3 = 0 THEN NULL ELSE {AS_OF} + (value % 100 - 20) * 1000 END AS due FROM fields) SELECT key, field, CAST(CASE WHEN due IS NULL THEN -1 WHEN due <= {AS_OF} THEN -2 ELSE due - {AS_OF} END AS BIGINT) AS ttl_ms FROM e")
def _(s, d):
    store = fields(s, d)
    due = store.where("value % 3 <> 0").select("key", "field", (F.lit(AS_OF) + (F.col("value") % 100 - 20) * 1000).alias("at"))
    held = hashes.expire_fields(store.withColumn("expire_at", F.lit(None).cast("long")), due, "NX")
    return hashes.remaining(held.select("key", "field", "expire_at"), store.select("key", "field"), AS_OF)


# ------------------------------------------------------------------------ lists: turns of a conversation

TURNS = "turns AS (SELECT DISTINCT conv_id AS key, turn AS pos, role AS value FROM conversations)"
RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS index, count(*) OVER (PARTITION BY key) AS n FROM turns)"


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), F.col("role").alias("value")).distinct()



@query("list_lrange", f"WITH {TURNS}, {RANKED} SELECT key, pos, value FROM r WHERE index BETWEEN 1 AND n - 2")
def _(s, d):
    return lists.range_of(turns(s, d), 1, -2).select("key", "pos", "value")


@query("list_lindex", f"WITH {TURNS}, {RANKED} SELECT key, pos, value FROM r WHERE index = n - 2")
def _(s, d):
    return lists.element(turns(s, d), -2).select("key", "pos", "value")


@query("list_lpop_rpop", f"WITH {TURNS} SELECT key, arg_min(value, pos) AS first, arg_max(value, pos) AS last, count(*) AS length FROM turns GROUP BY key")
def _(s, d):
    return lists.ends(turns(s, d))


@query("list_lpop_count", f"WITH {TURNS}, {RANKED} SELECT key, pos, value FROM r WHERE index >= 2")
def _(s, d):
    return lists.pop(turns(s, d), 2)[1].select("key", "pos", "value")


@query("list_ltrim", f"WITH {TURNS}, {RANKED} SELECT key, pos, value FROM r WHERE index >= n - 2")
def _(s, d):
    return lists.range_of(turns(s, d), -2, -1).select("key", "pos", "value")


@query("list_lrem", f"WITH {TURNS}, m AS (SELECT *, row_number() OVER (PARTITION BY key, value = 'user' ORDER BY pos DESC) AS k FROM turns) SELECT key, pos, value FROM m WHERE NOT (value = 'user' AND k <= 1)")
def _(s, d):
    return lists.remove(turns(s, d), "user", -1)


@query("list_lpos", f"WITH {TURNS}, {RANKED}, m AS (SELECT key, index, row_number() OVER (PARTITION BY key ORDER BY index) AS k FROM r WHERE value = 'user') SELECT key, index FROM m WHERE k BETWEEN 2 AND 3")
def _(s, d):
    return lists.positions(turns(s, d), "user", 2, 2).select("key", F.col("index").cast("long").alias("index"))


@query("list_linsert", f"WITH {TURNS} SELECT key, CAST(pos AS DOUBLE) AS pos, value FROM turns UNION ALL SELECT key, min(pos) - 0.5::DOUBLE, 'note' FROM turns WHERE value = 'assistant' GROUP BY key")
def _(s, d):
    return lists.insert(turns(s, d), "assistant", "note")


@query("list_lmove", f"WITH {TURNS}, t AS (SELECT * FROM turns WHERE key IN (1, 2)), top AS (SELECT max(pos) AS p FROM t WHERE key = 1), src AS (SELECT value FROM t, top WHERE key = 1 AND pos = p) SELECT key, pos, value FROM t WHERE NOT (key = 1 AND pos = (SELECT p FROM top)) UNION ALL SELECT 2, coalesce((SELECT min(pos) FROM t WHERE key = 2), 0) - 1, value FROM src")
def _(s, d):
    return lists.move(turns(s, d).where("key IN (1, 2)"), 1, 2, from_left=False, to_left=True)


@query("list_push", f"WITH {TURNS} SELECT key, pos, value FROM turns UNION ALL SELECT key, max(pos) + 1, 'system' FROM turns GROUP BY key")
def _(s, d):
    rows = turns(s, d)
    return lists.push(rows, rows.select("key").distinct().select("key", F.lit(0).cast("long").alias("pos"), F.lit("system").alias("value")), only_existing=True)


@query("list_lset", f"WITH {TURNS}, {RANKED} SELECT key, pos, CASE WHEN index = n - 1 THEN 'end' ELSE value END AS value FROM r")
def _(s, d):
    return lists.set_at(turns(s, d), -1, "end").select("key", "pos", "value")


# ------------------------------------------------------------------------- sets: parts of a supplier

MEMBERS = "members AS (SELECT DISTINCT l_suppkey AS key, l_partkey AS member FROM lineitem)"


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("member"))


@query("set_inter", f"WITH {MEMBERS} SELECT member FROM members WHERE key IN (1, 2) GROUP BY member HAVING count(*) = 2")
def _(s, d):
    return sets.intersect(parts(s, d), [1, 2])


@query("set_union", f"WITH {MEMBERS} SELECT DISTINCT member FROM members WHERE key IN (1, 2, 3)")
def _(s, d):
    return sets.union(parts(s, d), [1, 2, 3])


@query("set_diff", f"WITH {MEMBERS} SELECT member FROM members WHERE key = 1 EXCEPT SELECT member FROM members WHERE key IN (2, 3)")
def _(s, d):
    return sets.difference(parts(s, d), [1, 2, 3])


@query("set_card", f"WITH {MEMBERS} SELECT key, count(*) AS n FROM members GROUP BY key")
def _(s, d):
    return sets.sizes(parts(s, d))


@query("set_intercard_limit", f"WITH {MEMBERS}, i AS (SELECT member FROM members WHERE key IN (1, 2) GROUP BY member HAVING count(*) = 2) SELECT least(count(*), 3) AS n FROM i")
def _(s, d):
    return sets.cardinality(sets.intersect(parts(s, d), [1, 2]), 3)


@query("set_unioncard_diffcard", f"WITH {MEMBERS} SELECT (SELECT count(DISTINCT member) FROM members WHERE key IN (1, 2)) AS n_union, (SELECT count(*) FROM (SELECT member FROM members WHERE key = 1 EXCEPT SELECT member FROM members WHERE key = 2)) AS n_diff")
def _(s, d):
    p = parts(s, d)
    both = sets.cardinality(sets.union(p, [1, 2])).select(F.col("n").alias("n_union"), F.lit(1).alias("one"))
    return both.join(sets.cardinality(sets.difference(p, [1, 2])).select(F.col("n").alias("n_diff"), F.lit(1).alias("one")), "one").drop("one")


@query("set_ismember", f"WITH {MEMBERS}, r AS (SELECT p_partkey AS member FROM part) SELECT 1 AS key, r.member, m.member IS NOT NULL AS is_member FROM r LEFT JOIN members m ON m.key = 1 AND m.member = r.member")
def _(s, d):
    asked = table(s, d, "part").select(F.lit(1).cast("long").alias("key"), F.col("p_partkey").alias("member"))
    return sets.is_member(parts(s, d), asked).withColumn("key", F.col("key").cast("int"))


@query("set_smove", f"WITH {MEMBERS} SELECT DISTINCT CASE WHEN key = 1 AND member = 1 THEN 2 ELSE key END AS key, member FROM members WHERE key IN (1, 2)")
def _(s, d):
    return sets.move(parts(s, d).where("key IN (1, 2)"), 1, 2, 1)


@query("set_srem_store", f"WITH {MEMBERS} SELECT 'dest' AS key, member FROM members WHERE key IN (1, 2) AND member % 2 = 1 GROUP BY member HAVING count(*) = 2")
def _(s, d):
    p = parts(s, d)
    return sets.store(sets.intersect(sets.remove(p, p.where("member % 2 = 0").select("key", "member").distinct()), [1, 2]), "dest")


@query("set_randmember_size", f"WITH {MEMBERS} SELECT key, least(5, count(*)) AS n FROM members GROUP BY key")
def _(s, d):
    return sets.sample(parts(s, d), 5, seed=42).groupBy("key").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------- sorted sets: orders of a priority

Z = "z AS (SELECT o_orderpriority AS key, o_orderkey AS member, o_totalprice AS score FROM orders)"
ZR = "r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS revrank, count(*) OVER (PARTITION BY key) AS n FROM z)"


def zset(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_orderkey").alias("member"), F.col("o_totalprice").alias("score"))


@query("z_range_rank", f"WITH {Z}, {ZR} SELECT key, member, score, rank FROM r WHERE rank BETWEEN 0 AND 9")
def _(s, d):
    return zsets.by_rank(zset(s, d), 0, 9).withColumn("rank", F.col("rank").cast("long"))


@query("z_range_negative", f"WITH {Z}, {ZR} SELECT key, member, score FROM r WHERE rank >= n - 3")
def _(s, d):
    return zsets.by_rank(zset(s, d), -3, -1).drop("rank")


@query("z_revrange", f"WITH {Z}, {ZR} SELECT key, member, score FROM r WHERE revrank BETWEEN 0 AND 4")
def _(s, d):
    return zsets.by_rank(zset(s, d), 0, 4, reverse=True).drop("rank")


@query("z_rangebyscore", f"WITH {Z} SELECT * FROM z WHERE score > 1000 AND score <= 50000")
def _(s, d):
    return zsets.by_score(zset(s, d), 1000.0, 50000.0, low_open=True)


@query("z_rangebylex", "SELECT c_mktsegment AS key, c_name AS member, 0 AS score FROM customer WHERE c_name >= 'Customer#000000010' AND c_name < 'Customer#000000200'")
def _(s, d):
    rows = table(s, d, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("member"), F.lit(0).alias("score"))
    return zsets.by_member(rows, "Customer#000000010", "Customer#000000200", high_open=True)


@query("z_rank", f"WITH {Z}, {ZR} SELECT key, member, rank, revrank FROM r")
def _(s, d):
    up = zsets.ranked(zset(s, d)).select("key", "member", F.col("rank").cast("long").alias("rank"))
    down = zsets.ranked(zset(s, d), reverse=True).select("key", "member", F.col("rank").cast("long").alias("revrank"))
    return up.join(down, ["key", "member"])


@query("z_count", f"WITH {Z} SELECT key, count(*) AS n FROM z WHERE score BETWEEN 1000 AND 100000 GROUP BY key")
def _(s, d):
    return zsets.by_score(zset(s, d), 1000.0, 100000.0).groupBy("key").agg(F.count("*").alias("n"))


@query("z_incrby", "SELECT event_type AS key, user_id AS member, round(sum(value), 4) AS score FROM events GROUP BY 1, 2")
def _(s, d):
    rows = table(s, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("member"), F.col("value").alias("delta"))
    return zsets.increment(rows).withColumn("score", F.round("score", 4))


ZP = "z AS (SELECT l_suppkey AS key, l_partkey AS member, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2)"


def quantities(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    return rows.groupBy(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("member")).agg(F.sum("l_quantity").alias("score"))


@query("z_union_weights", f"WITH {ZP} SELECT member, sum(score * CASE key WHEN 1 THEN 2.0 ELSE 3.0 END) AS score FROM z WHERE key IN (1, 2) GROUP BY member")
def _(s, d):
    return zsets.combine(quantities(s, d), [1, 2], "union", [2.0, 3.0])


@query("z_inter_max", f"WITH {ZP} SELECT member, max(score) AS score FROM z WHERE key IN (1, 2) GROUP BY member HAVING count(*) = 2")
def _(s, d):
    return zsets.combine(quantities(s, d), [1, 2], "inter", aggregate="max")


@query("z_diff", f"WITH {ZP} SELECT member, score FROM z WHERE key = 1 AND member NOT IN (SELECT member FROM z WHERE key IN (2, 3))")
def _(s, d):
    return zsets.difference(quantities(s, d).where("key <= 3"), [1, 2, 3])


@query("z_popmin", f"WITH {Z}, {ZR} SELECT key, member, score FROM r WHERE rank < 3")
def _(s, d):
    return zsets.pop(zset(s, d), 3)[0]


@query("z_popmax_rest", f"WITH {Z}, {ZR} SELECT key, count(*) AS n, max(score) AS top FROM r WHERE revrank >= 2 GROUP BY key")
def _(s, d):
    return zsets.pop(zset(s, d), 2, highest=True)[1].groupBy("key").agg(F.count("*").alias("n"), F.max("score").alias("top"))


@query("z_remrangebyrank", f"WITH {Z}, {ZR} SELECT key, member, score FROM r WHERE rank > 9")
def _(s, d):
    return zsets.without_ranks(zset(s, d), 0, 9)


@query("z_mscore", f"WITH {Z}, q AS (SELECT DISTINCT key FROM z), a AS (SELECT key, m AS member FROM q, (VALUES (1), (2), (999999999)) v(m)) SELECT a.key, a.member, z.score FROM a LEFT JOIN z ON a.key = z.key AND a.member = z.member")
def _(s, d):
    rows = zset(s, d)
    asked = rows.select("key").distinct().withColumn("member", F.explode(F.array(*(F.lit(x) for x in (1, 2, 999999999)))))
    return zsets.scores(rows, asked)


@query("z_add_gt", f"WITH {Z} SELECT key, member, greatest(score, CASE WHEN member % 2 = 0 THEN 100000.0 END) AS score FROM z")
def _(s, d):
    rows = zset(s, d)
    new = rows.where("member % 2 = 0").select("key", "member", F.lit(100000.0).alias("score"))
    return zsets.add(rows, new, "GT")


# ---------------------------------------------------------------------------------------- keys

KEYS = f"keys AS (SELECT 'order:' || o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE {AS_OF} + (o_orderkey % 200 - 50) * 1000 END AS expire_at FROM orders)"


def keys(spark: SparkSession, sf: str) -> DataFrame:
    at = F.when(F.col("o_orderkey") % 3 != 0, F.lit(AS_OF) + (F.col("o_orderkey") % 200 - 50) * 1000)
    return table(spark, sf, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey")).alias("key"), at.alias("expire_at"))


@query("ttl_filter", f"WITH {KEYS} SELECT key, CAST(CASE WHEN expire_at IS NULL THEN -1 WHEN expire_at <= {AS_OF} THEN -2 ELSE expire_at - {AS_OF} END AS BIGINT) AS ttl_ms FROM keys")
def _(s, d):
    return keys(s, d).select("key", keyspace.remaining_ms(F.col("expire_at"), AS_OF, F.lit(True)).alias("ttl_ms"))


@query("expire_gt", f"WITH {KEYS} SELECT key, CASE WHEN expire_at < {AS_OF} + 60000 THEN {AS_OF} + 60000 ELSE expire_at END AS expire_at FROM keys")
def _(s, d):
    return keyspace.expire(keys(s, d), F.lit(AS_OF + 60000), "GT")


@query("keys_glob", "SELECT c_name FROM customer WHERE regexp_full_match(c_name, 'Customer#.*1[0-4].')")
def _(s, d):
    return keyspace.matching(table(s, d, "customer").select("c_name"), "Customer#*1[0-4]?", "c_name")


@query("keys_prefix", "SELECT c_name FROM customer WHERE starts_with(c_name, 'Customer#0000001')")
def _(s, d):
    return keyspace.matching(table(s, d, "customer").select("c_name"), "Customer#0000001*", "c_name")


@query("scan_paging", f"WITH {KEYS} SELECT count(*) AS n, count(DISTINCT key) AS n_keys FROM keys")
def _(s, d):
    rows = keys(s, d).select("key")
    page = keyspace.scan(rows, -(1 << 63), 100)
    rest = rows.join(page.select("key"), "key", "left_anti")
    both = page.select("key").unionByName(rest)
    return both.agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_keys"))


@query("copy_rename", "SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'now' ELSE o_orderpriority END AS key, o_orderkey AS member FROM orders UNION ALL SELECT 'copy', o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH'")
def _(s, d):
    rows = zset(s, d).select("key", "member")
    return keyspace.rename(keyspace.copy(rows, "2-HIGH", "copy"), "1-URGENT", "now")


@query("type_counts", "SELECT 'string' AS type, count(*) AS n FROM customer UNION ALL SELECT 'zset', count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'list', count(DISTINCT conv_id) FROM conversations")
def _(s, d):
    kinds = [("string", table(s, d, "customer").select("c_custkey")), ("zset", table(s, d, "orders").select("o_orderpriority").distinct()), ("list", table(s, d, "conversations").select("conv_id").where("conv_id IS NOT NULL").distinct())]
    parts_ = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("type"), "n") for kind, df in kinds]
    return parts_[0].unionByName(parts_[1]).unionByName(parts_[2])


@query("sort_by_external", "SELECT o_orderkey AS member, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' ORDER BY c_acctbal DESC, o_orderkey LIMIT 20 OFFSET 5")
def _(s, d):
    members = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("member"), F.col("o_custkey"))
    external = members.join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("member", "c_acctbal", "c_name")
    return keyspace.sort_by(members.select("member"), external, "member", "c_acctbal", ["c_name"], 20, 5, descending=True)


@query("sort_alpha_limit", "SELECT p_name FROM part ORDER BY p_name, p_partkey LIMIT 10")
def _(s, d):
    return table(s, d, "part").orderBy("p_name", "p_partkey").limit(10).select("p_name")


@query("exists_count", "SELECT count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))")
def _(s, d):
    return keyspace.exists_count(table(s, d, "customer").where("c_acctbal > 0"), table(s, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("swapdb", "SELECT CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END AS db, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    rows = table(s, d, "orders").select((F.col("o_orderkey") % 3).cast("int").alias("db"))
    return keyspace.swap(rows, 0, 1).groupBy("db").agg(F.count("*").alias("n"))
