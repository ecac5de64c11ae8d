"""Deletes, conditional and expiring writes, stores and samples over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import byte_range, geohash52, overwrite
from ..operators import agent, bitmaps, crdt, geo, hashes, jsonops, keyspace, lists, search, sets, sketches, streams, strings, vectors, zsets
from ..sources.tables import table
from .data_plans import CR, MILLIS_SQL, PLACES, END, P, X, documents_of, entries, messages, metres, pending, places, replicas, span
from .keyspace_plans import AS_OF, FIELDS, KEYS, LOG, TURNS, Z, ZR, fields, keys, log, parts, turns, zset
from .registry import query
from .search_plans import ANALYZED, DIST, Q0, base_vectors, index, rounded

# ----------------------------------------------------------------------------- strings

STORE = f"{LOG}, store AS (SELECT key, arg_max(value, seq) AS value, CASE WHEN key % 3 = 0 THEN NULL ELSE {AS_OF} + key END AS expire_at FROM log GROUP BY key)"
NEW = f"new AS (SELECT c_custkey AS key, c_mktsegment AS value, CASE WHEN c_custkey % 2 = 0 THEN {AS_OF} + 1000 END AS expire_at FROM customer)"
BOTH = "(SELECT coalesce(s.key, n.key) AS key, s.value AS old, s.expire_at AS old_at, n.value AS new, n.expire_at AS new_at, s.key IS NOT NULL AS there, n.key IS NOT NULL AS wanted FROM store s FULL JOIN new n ON s.key = n.key)"


def store(s: SparkSession, d: str) -> DataFrame:
    return strings.latest(log(s, d)).withColumn("expire_at", F.when(F.col("key") % 3 != 0, F.lit(AS_OF) + F.col("key")))


def new_values(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"), F.when(F.col("c_custkey") % 2 == 0, F.lit(AS_OF + 1000)).alias("expire_at"))


@query("str_setex", f"WITH {STORE}, {NEW} SELECT key, CASE WHEN wanted THEN new ELSE old END AS value, CASE WHEN wanted THEN new_at ELSE old_at END AS expire_at FROM {BOTH}")
def _(s, d):
    return strings.set_many(store(s, d), new_values(s, d)).drop("old")


@query("str_set_xx_keepttl", f"WITH {STORE}, {NEW} SELECT key, CASE WHEN wanted THEN new ELSE old END AS value, old_at AS expire_at FROM {BOTH} WHERE there")
def _(s, d):
    return strings.set_many(store(s, d), new_values(s, d), "XX", keep_ttl=True).drop("old")


@query("str_set_nx_get", f"WITH {STORE}, {NEW} SELECT key, coalesce(old, new) AS value, CASE WHEN wanted THEN old END AS old FROM {BOTH}")
def _(s, d):
    return strings.set_many(store(s, d), new_values(s, d), "NX").drop("expire_at")


@query("str_set_ifeq", f"WITH {STORE}, {NEW} SELECT key, CASE WHEN wanted AND old = 'click' THEN new ELSE old END AS value FROM {BOTH} WHERE there")
def _(s, d):
    return strings.set_many(store(s, d), new_values(s, d).withColumn("compare", F.lit("click")), "IFEQ").select("key", "value")


@query("str_msetex_nx", f"WITH {STORE}, {NEW} SELECT key, value, expire_at FROM store UNION ALL SELECT key, value, expire_at FROM new WHERE NOT EXISTS (SELECT 1 FROM new n JOIN store USING (key)) AND key NOT IN (SELECT key FROM store)")
def _(s, d):
    return strings.set_all(store(s, d), new_values(s, d), "NX").select("key", "value", "expire_at")


@query("str_msetex", f"WITH {STORE}, {NEW}, more AS (SELECT 1000000 + key AS key, value, expire_at FROM new) SELECT key, value, expire_at FROM store UNION ALL SELECT key, value, expire_at FROM more")
def _(s, d):
    return strings.set_all(store(s, d), new_values(s, d).withColumn("key", F.col("key") + 1_000_000), "NX").select("key", "value", "expire_at")


@query("str_getdel", f"WITH {STORE} SELECT 'got' AS part, c_custkey AS key, value FROM customer LEFT JOIN store ON key = c_custkey WHERE c_custkey % 5 = 0 UNION ALL SELECT 'left', key, value FROM store WHERE key NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)")
def _(s, d):
    asked = table(s, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("key"))
    got, left = strings.get_and_delete(store(s, d), asked)
    return got.select(F.lit("got").alias("part"), "key", "value").unionByName(left.select(F.lit("left").alias("part"), "key", "value"))


@query("str_getex", f"WITH {STORE} SELECT key, value, CASE WHEN key % 4 = 0 THEN NULL WHEN key % 4 = 1 THEN {AS_OF} + 60000 ELSE expire_at END AS expire_at FROM store")
def _(s, d):
    rows = store(s, d)
    asked = rows.where("key % 4 < 2").select("key", F.when(F.col("key") % 4 == 1, F.lit(AS_OF + 60_000)).alias("at"))
    return strings.get_and_expire(rows, asked)[1]


@query("str_delex_ifne", f"WITH {STORE} SELECT key, value FROM store WHERE value = 'click'")
def _(s, d):
    rows = store(s, d)
    return strings.delete_if(rows, rows.select("key", F.lit("click").alias("value")), "IFNE").select("key", "value")


@query("str_delex_ifdeq", f"WITH {STORE} SELECT key, value FROM store WHERE value <> 'click'")
def _(s, d):
    rows = store(s, d)
    return strings.delete_if(rows, rows.select("key", strings.value_digest(F.lit("click")).alias("value")), "IFDEQ").select("key", "value")


@query("str_delex_ifdne", f"WITH {STORE} SELECT key, value FROM store WHERE value = 'click'")
def _(s, d):
    rows = store(s, d)
    return strings.delete_if(rows, rows.select("key", strings.value_digest(F.lit("click")).alias("value")), "IFDNE").select("key", "value")


#: The usual table, a row a step: each place holds the greatest of what stood there, of a match's diagonal, and of the places before it.
LCS_SQL = """WITH RECURSIVE pairs AS (SELECT DISTINCT upper(p_name) AS a, upper(p_type) AS b FROM part),
  w AS (SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda j: 0) AS prev FROM pairs
    UNION ALL SELECT a, b, i + 1, list_prepend(0, list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CAST(greatest(prev[k + 1], CASE WHEN substr(a, CAST(w.i + 1 AS INTEGER), 1) = substr(b, CAST(k AS INTEGER), 1) THEN prev[k] + 1 ELSE 0 END) AS INTEGER))))) FROM w WHERE i < length(a))
  SELECT p_partkey, CAST(list_last(prev) AS INTEGER) AS n FROM part JOIN w ON w.a = upper(p_name) AND w.b = upper(p_type) AND w.i = length(w.a)"""


@query("str_lcs_len", LCS_SQL)
def _(s, d):
    return table(s, d, "part").select("p_partkey", strings.common_length(F.upper("p_name"), F.upper("p_type")).alias("n"))


@query("str_lcs_idx")
def _(s, d):
    found = table(s, d, "part").select("p_partkey", F.explode(strings.common_ranges(F.upper("p_name"), F.upper("p_type"))).alias("r"))
    return found.select("p_partkey", "r.*")


@query("str_setrange_bytes", "SELECT doc_id, md5(unhex(substr(h, 1, 20) || '2323' || substr(h, 25))) AS digest, least(7, n - 3) AS n FROM (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents) WHERE n >= 12")
def _(s, d):
    docs = table(s, d, "documents").where(F.octet_length("text") >= 12)
    return docs.select("doc_id", F.md5(overwrite(F.col("text"), 10, "##")).alias("digest"), F.octet_length(byte_range(F.col("text"), 3, 9)).alias("n"))


# ----------------------------------------------------------------------------- bits

BITS_ALL = 'bits AS (SELECT DISTINCT event_type AS key, (event_id % 100000) * (event_id % 100000) % (length(event_type) * 97) AS "offset" FROM events)'


def bits(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("event_type").alias("key"), ((F.col("event_id") % 100_000) * (F.col("event_id") % 100_000) % (F.length("event_type") * 97)).alias("offset")).distinct()


for _name, _sql in {
    "or": 'SELECT DISTINCT "offset" FROM bits WHERE key IN (\'click\', \'view\')',
    "diff1": 'SELECT DISTINCT "offset" FROM bits WHERE key IN (\'view\', \'purchase\') AND "offset" NOT IN (SELECT "offset" FROM bits WHERE key = \'click\')',
    "andor": 'SELECT DISTINCT "offset" FROM bits WHERE key IN (\'view\', \'purchase\') AND "offset" IN (SELECT "offset" FROM bits WHERE key = \'click\')',
    "one": 'SELECT "offset" FROM bits WHERE key IN (\'click\', \'view\', \'purchase\') GROUP BY "offset" HAVING count(*) = 1',
}.items():

    def _combined(name: str):
        return lambda s, d: bitmaps.combine(bits(s, d), name, keys=["click", "view"] if name == "or" else ["click", "view", "purchase"])

    query(f"bit_op_{_name}", f"WITH {BITS_ALL} {_sql}")(_combined(_name))


@query("bit_get", f'WITH {BITS_ALL}, asked AS (SELECT DISTINCT key, o AS "offset" FROM bits, range(0, 64) r(o)) SELECT a.key, a."offset", CAST(b.key IS NOT NULL AS INTEGER) AS bit FROM asked a LEFT JOIN bits b ON a.key = b.key AND a."offset" = b."offset"')
def _(s, d):
    rows = bits(s, d)
    asked = rows.select("key").distinct().withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
    return bitmaps.get_bits(rows, asked)


@query("bit_set_clear", 'SELECT key, "offset" FROM (SELECT event_type AS key, user_id AS "offset", arg_max(event_id % 2, event_id) AS b FROM events GROUP BY 1, 2) WHERE b = 1')
def _(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("offset"), (F.col("event_id") % 2).alias("bit"), F.col("event_id").alias("seq"))
    return bitmaps.set_bits(e)


@query("bitfield_get", f'WITH {BITS_ALL}, v AS (SELECT key, coalesce(sum(CASE WHEN "offset" BETWEEN 8 AND 19 THEN 1::BIGINT << (19 - "offset")::INTEGER END), 0) AS v FROM bits GROUP BY key) SELECT key, CAST(v AS BIGINT) AS u, CAST(CASE WHEN v >= 2048 THEN v - 4096 ELSE v END AS BIGINT) AS i FROM v')
def _(s, d):
    rows = bits(s, d)
    return bitmaps.field_value(rows, 8, 12, signed=False).withColumnRenamed("value", "u").join(bitmaps.field_value(rows, 8, 12).withColumnRenamed("value", "i"), "key")


@query("bitfield_set", f'WITH {BITS_ALL} SELECT key, "offset" FROM bits WHERE NOT (key = \'click\' AND "offset" BETWEEN 4 AND 11) UNION ALL SELECT \'click\', i + 4 FROM range(0, 8) r(i) WHERE (165 >> (7 - i)::INTEGER) & 1 = 1')
def _(s, d):
    rows = bits(s, d)
    return bitmaps.set_field(rows, 4, 8, rows.where("key = 'click'").select("key").distinct().withColumn("value", F.lit(165 - 256)))


# ----------------------------------------------------------------------------- hashes

HSTORE = f"{FIELDS}, h AS (SELECT key, field, value, CASE WHEN value % 3 = 0 THEN NULL ELSE {AS_OF} + value END AS expire_at FROM fields)"
HNEW = f"hn AS (SELECT c_custkey AS key, f AS field, c_custkey * 10 AS value, {AS_OF} + 5000 AS expire_at FROM customer, (VALUES ('click'), ('joined')) v(f))"


def hash_store(s: SparkSession, d: str) -> DataFrame:
    return fields(s, d).withColumn("expire_at", F.when(F.col("value") % 3 != 0, F.lit(AS_OF) + F.col("value")))


def hash_new(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.explode(F.array(F.lit("click"), F.lit("joined"))).alias("field"))
    return c.withColumn("value", F.col("key") * 10).withColumn("expire_at", F.lit(AS_OF + 5000))


@query("hash_hsetex", f"WITH {HSTORE}, {HNEW} SELECT coalesce(h.key, n.key) AS key, coalesce(h.field, n.field) AS field, coalesce(n.value, h.value) AS value, CASE WHEN n.key IS NOT NULL THEN n.expire_at ELSE h.expire_at END AS expire_at FROM h FULL JOIN hn n ON h.key = n.key AND h.field = n.field")
def _(s, d):
    return hashes.set_fields_expiring(hash_store(s, d), hash_new(s, d))


@query("hash_hsetex_fnx", f"WITH {HSTORE}, {HNEW}, ok AS (SELECT key FROM hn GROUP BY key HAVING key NOT IN (SELECT h.key FROM h JOIN hn USING (key, field))) SELECT key, field, value FROM h UNION ALL SELECT key, field, value FROM hn WHERE key IN (SELECT key FROM ok)")
def _(s, d):
    return hashes.set_fields_expiring(hash_store(s, d), hash_new(s, d), "FNX").drop("expire_at")


@query("hash_hgetdel", f"WITH {HSTORE} SELECT 'got' AS part, c_custkey AS key, 'view' AS field, value FROM customer LEFT JOIN h ON key = c_custkey AND field = 'view' UNION ALL SELECT 'left', key, field, value FROM h WHERE NOT (field = 'view' AND key IN (SELECT c_custkey FROM customer))")
def _(s, d):
    asked = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("view").alias("field"))
    got, left = hashes.get_and_delete_fields(hash_store(s, d), asked)
    return got.select(F.lit("got").alias("part"), "key", "field", "value").unionByName(left.select(F.lit("left").alias("part"), "key", "field", "value"))


@query("hash_hgetex", f"WITH {HSTORE} SELECT key, field, value, CASE WHEN field = 'click' THEN {AS_OF} + 9000 ELSE expire_at END AS expire_at FROM h")
def _(s, d):
    rows = hash_store(s, d)
    return hashes.get_and_expire_fields(rows, rows.where("field = 'click'").select("key", "field", F.lit(AS_OF + 9000).alias("at")))[1]


@query("hash_hpersist", f"WITH {HSTORE} SELECT key, field, CASE WHEN field <> 'view' THEN expire_at END AS expire_at FROM h")
def _(s, d):
    rows = hash_store(s, d)
    return hashes.persist_fields(rows, rows.where("field = 'view'").select("key", "field")).drop("value")


@query("hash_hexists_hstrlen", f"WITH {HSTORE} SELECT c_custkey AS key, value IS NOT NULL AS there, coalesce(length(CAST(value AS VARCHAR)), 0) AS n FROM customer LEFT JOIN h ON key = c_custkey AND field = 'click'")
def _(s, d):
    asked = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("click").alias("field"))
    got = hashes.get_fields(hash_store(s, d), asked)
    return got.select("key", F.col("value").isNotNull().alias("there"), F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0)).cast("long").alias("n"))


@query("hash_hvals", f"WITH {HSTORE} SELECT key, string_agg(CAST(value AS VARCHAR), ',' ORDER BY field) AS vals FROM h GROUP BY key")
def _(s, d):
    maps = hashes.as_map(hash_store(s, d))
    return maps.select("key", F.array_join(F.transform(F.map_values("fields"), lambda v: v.cast("string")), ",").alias("vals"))


@query("hash_himport", "SELECT c_custkey AS key, field, value FROM (SELECT c_custkey, unnest(['name', 'segment']) AS field, unnest([c_name, c_mktsegment]) AS value FROM customer)")
def _(s, d):
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.array("c_name", "c_mktsegment").alias("values"))
    return hashes.import_rows(rows, ["name", "segment"])


@query("hash_hrandfield", f"WITH {FIELDS} SELECT key, least(2, count(*)) AS n, true AS members FROM fields GROUP BY key")
def _(s, d):
    rows = fields(s, d)
    drawn = hashes.sample_fields(rows, 2, seed=7)
    held = drawn.join(rows.select("key", "field", F.lit(True).alias("own")), ["key", "field"], "left")
    return held.groupBy("key").agg(F.countDistinct("field").alias("n"), F.every(F.col("own").isNotNull()).alias("members"))


def whole_scan(rows: DataFrame, scan) -> DataFrame:
    """Two pages, the second from each key's last slot on: every member once, as there are fewer than the two pages hold."""
    first = scan(rows, -(1 << 63))
    last = first.groupBy("key").agg(F.max("slot").alias("last"))
    rest = rows.join(last, "key").where(F.xxhash64(rows.columns[1]) > F.col("last")).drop("last")
    return first.drop("slot").unionByName(scan(rest, -(1 << 63)).drop("slot"))


@query("hash_hscan", f"WITH {FIELDS} SELECT key, field FROM fields WHERE field LIKE '%i%'")
def _(s, d):
    rows = fields(s, d).select("key", "field")
    page = lambda r, cursor: hashes.scan_fields(r, cursor, 3)
    return keyspace.matching(whole_scan(rows, page), "*i*", "field")


# ----------------------------------------------------------------------------- lists, sets, sorted sets


@query("list_lmpop_first", f"WITH {TURNS}, k AS (SELECT min(CASE key WHEN 2 THEN 1 WHEN 3 THEN 2 END) AS o FROM turns WHERE key IN (2, 3)), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS n FROM turns WHERE key = CASE (SELECT o FROM k) WHEN 1 THEN 2 ELSE 3 END) SELECT key, pos, value FROM r WHERE n <= 2")
def _(s, d):
    return lists.pop_first(turns(s, d), [-1, 2, 3], 2)[0]


@query("list_llen", f"WITH {TURNS} SELECT key, count(*) AS n FROM turns GROUP BY key")
def _(s, d):
    return lists.ends(turns(s, d)).select("key", F.col("length").alias("n"))


SMEMBERS = "members AS (SELECT DISTINCT l_suppkey AS key, l_partkey AS member FROM lineitem)"


@query("set_add", f"WITH {SMEMBERS} SELECT key, member FROM members UNION SELECT s_suppkey, 1 FROM supplier")
def _(s, d):
    return sets.add(parts(s, d), table(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.lit(1).cast("long").alias("member")))


@query("set_members", f"WITH {SMEMBERS} SELECT member FROM members WHERE key = 3")
def _(s, d):
    return sets.members(parts(s, d), 3)


@query("set_spop_rest", f"WITH {SMEMBERS} SELECT key, least(5, count(*)) AS popped, greatest(0, count(*) - 5) AS rest, count(*) AS whole FROM members GROUP BY key")
def _(s, d):
    popped, rest = sets.pop(parts(s, d), 5, seed=3)
    both = popped.withColumn("p", F.lit(1)).unionByName(rest.withColumn("p", F.lit(0)))
    each = both.groupBy("key", "member").agg(F.max("p").alias("p"))  # a member is in one of the two
    return each.groupBy("key").agg(F.sum("p").cast("long").alias("popped"), F.sum(1 - F.col("p")).cast("long").alias("rest"), F.count("*").alias("whole"))


@query("set_sscan", f"WITH {SMEMBERS} SELECT key, CAST(member AS VARCHAR) AS member FROM members WHERE CAST(member AS VARCHAR) LIKE '1%'")
def _(s, d):
    rows = parts(s, d).distinct().select("key", F.col("member").cast("string").alias("member"))
    page = lambda r, cursor: keyspace.scan_within(r, cursor, 1 << 20)
    return keyspace.matching(whole_scan(rows, page), "1*", "member")


@query("z_rem", f"WITH {Z} SELECT key, member, score FROM z WHERE member % 3 <> 0")
def _(s, d):
    rows = zset(s, d)
    return zsets.remove(rows, rows.where("member % 3 = 0"))


@query("z_remrangebyscore", f"WITH {Z} SELECT key, member, score FROM z WHERE NOT (score > 1000 AND score <= 100000)")
def _(s, d):
    return zsets.without_scores(zset(s, d), 1000.0, 100000.0, low_open=True)


CUSTOMERS = "z AS (SELECT c_mktsegment AS key, c_name AS member, c_acctbal AS score FROM customer)"


def customers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score"))


@query("z_remrangebylex", f"WITH {CUSTOMERS} SELECT key, member, score FROM z WHERE NOT (member >= 'Customer#000000050' AND member < 'Customer#000000300')")
def _(s, d):
    return zsets.without_members(customers(s, d), "Customer#000000050", "Customer#000000300", high_open=True)


@query("z_revrangebyscore_limit", f"WITH {Z}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) AS n FROM z WHERE score BETWEEN 1000 AND 200000) SELECT key, member, score FROM r WHERE n BETWEEN 3 AND 7")
def _(s, d):
    return zsets.page(zsets.by_score(zset(s, d), 1000.0, 200000.0), "score", 5, 2, reverse=True)


@query("z_revrangebylex_limit", f"WITH {CUSTOMERS}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member DESC) AS n FROM z WHERE member <= 'Customer#000001000') SELECT key, member FROM r WHERE n BETWEEN 2 AND 4")
def _(s, d):
    return zsets.page(zsets.by_member(customers(s, d), None, "Customer#000001000"), "member", 3, 1, reverse=True).select("key", "member")


@query("z_intercard", "WITH z AS (SELECT l_suppkey AS key, l_partkey AS member, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2) SELECT least(count(*), 4) AS n FROM (SELECT member FROM z WHERE key IN (1, 2) GROUP BY member HAVING count(*) = 2)")
def _(s, d):
    return zsets.intersection_size(parts(s, d), [1, 2], 4)


ZSTORED = "WITH z AS (SELECT l_suppkey AS key, l_partkey AS member, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2)"


def amounts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("member")).agg(F.sum("l_quantity").alias("score"))


@query("z_unionstore", f"{ZSTORED} SELECT key, member, score FROM z WHERE key <> 5 UNION ALL SELECT 5, member, sum(score) FROM z WHERE key IN (1, 2) GROUP BY member")
def _(s, d):
    rows = amounts(s, d)
    return zsets.replace(rows, zsets.combine(rows, [1, 2], "union"), 5)


@query("z_interstore", f"{ZSTORED} SELECT 'dest' AS key, member, min(score) AS score FROM z WHERE key IN (1, 2) GROUP BY member HAVING count(*) = 2")
def _(s, d):
    return zsets.store(zsets.combine(amounts(s, d), [1, 2], "inter", aggregate="min"), "dest")


@query("z_diffstore", f"{ZSTORED} SELECT 'dest' AS key, member, score FROM z WHERE key = 1 AND member NOT IN (SELECT member FROM z WHERE key IN (2, 3))")
def _(s, d):
    return zsets.store(zsets.difference(amounts(s, d), [1, 2, 3]), "dest")


@query("z_rangestore", f"WITH {Z}, {ZR} SELECT 'top' AS key, member, score FROM r WHERE key = '1-URGENT' AND revrank < 10")
def _(s, d):
    return zsets.store(zsets.by_rank(zset(s, d).where("key = '1-URGENT'"), 0, 9, reverse=True), "top")


for _condition, _value in {"NX": "coalesce(z.score, n.score)", "XX": "CASE WHEN z.key IS NOT NULL THEN coalesce(n.score, z.score) END", "LT": "least(z.score, n.score)"}.items():

    def _added(condition: str):
        def plan(s, d):
            rows = zset(s, d)
            new = rows.where("member % 2 = 0").select("key", "member", F.lit(50000.0).alias("score"))
            fresh = new.limit(0).unionByName(rows.where("member % 5 = 0").select("key", (-F.col("member")).alias("member"), F.lit(1.0).alias("score")))
            return zsets.add(rows, new.unionByName(fresh), condition)

        return plan

    query(f"z_add_{_condition.lower()}", f"WITH {Z}, n AS (SELECT key, member, 50000.0::DOUBLE AS score FROM z WHERE member % 2 = 0 UNION ALL SELECT key, -member, 1.0::DOUBLE FROM z WHERE member % 5 = 0), u AS (SELECT coalesce(z.key, n.key) AS key, coalesce(z.member, n.member) AS member, {_value} AS score FROM z FULL JOIN n ON z.key = n.key AND z.member = n.member) SELECT key, member, score FROM u WHERE score IS NOT NULL")(_added(_condition))


@query("z_mpop_first", f"WITH {Z}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) AS n FROM z WHERE key = '2-HIGH') SELECT key, member, score FROM r WHERE n <= 4")
def _(s, d):
    return zsets.pop_first(zset(s, d), ["none", "2-HIGH", "1-URGENT"], 4, highest=True)[0]


@query("z_randmember", f"WITH {Z} SELECT key, least(6, count(*)) AS n, true AS members FROM z GROUP BY key")
def _(s, d):
    rows = zset(s, d)
    drawn = zsets.sample_members(rows, 6, seed=5).join(rows.withColumn("own", F.lit(True)), ["key", "member", "score"], "left")
    return drawn.groupBy("key").agg(F.countDistinct("member").alias("n"), F.every(F.col("own").isNotNull()).alias("members"))


@query("z_scan", f"WITH {CUSTOMERS} SELECT key, member, score FROM z WHERE member LIKE '%7'")
def _(s, d):
    page = lambda r, cursor: zsets.scan_members(r, cursor, 1 << 20)
    return keyspace.matching(whole_scan(customers(s, d), page), "*7", "member")


# ----------------------------------------------------------------------------- keys


@query("key_del", f"WITH {KEYS} SELECT key FROM keys WHERE key NOT IN (SELECT 'order:' || o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(s, d):
    gone = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("order:"), F.col("o_orderkey")).alias("key"))
    return keyspace.delete(keys(s, d), gone).select("key")


@query("key_persist", f"WITH {KEYS} SELECT key, CASE WHEN key NOT LIKE '%7' THEN expire_at END AS expire_at FROM keys")
def _(s, d):
    rows = keys(s, d)
    return keyspace.persist(rows, rows.where("key LIKE '%7'"))


@query("key_dbsize", f"WITH {KEYS} SELECT count(*) AS n FROM keys WHERE expire_at IS NULL OR expire_at > {AS_OF}")
def _(s, d):
    return keyspace.size(keys(s, d), AS_OF)


DBS = "k AS (SELECT o_custkey % 50 AS key, CAST(o_orderkey % 3 AS INTEGER) AS db, o_orderkey AS member FROM orders)"


def in_databases(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select((F.col("o_custkey") % 50).alias("key"), (F.col("o_orderkey") % 3).cast("int").alias("db"), F.col("o_orderkey").alias("member"))


@query("key_move", f"WITH {DBS}, gone AS (SELECT DISTINCT key FROM k WHERE db = 1 AND key % 4 = 0 AND key NOT IN (SELECT key FROM k WHERE db = 0 AND key % 8 = 0)), t AS (SELECT * FROM k WHERE NOT (db = 0 AND key % 8 <> 0)) SELECT key, CASE WHEN db = 1 AND key IN (SELECT key FROM gone) THEN 0 ELSE db END AS db, member FROM t")
def _(s, d):
    rows = in_databases(s, d).where("NOT (db = 0 AND key % 8 <> 0)")
    asked = rows.where("db = 1 AND key % 4 = 0").select("key", "db").distinct()
    return keyspace.move_to(rows, asked, 0)


@query("key_move_replace", f"WITH {DBS}, a AS (SELECT DISTINCT key FROM k WHERE db = 1 AND key % 4 = 0) SELECT key, CASE WHEN db = 1 AND key IN (SELECT key FROM a) THEN 0 ELSE db END AS db, member FROM k WHERE NOT (db = 0 AND key IN (SELECT key FROM a))")
def _(s, d):
    rows = in_databases(s, d)
    return keyspace.move_to(rows, rows.where("db = 1 AND key % 4 = 0").select("key", "db"), 0, replace=True)


@query("key_random", "SELECT 1 AS n, true AS member")
def _(s, d):
    rows = keys(s, d)
    found = keyspace.random_key(rows, seed=9)
    return found.join(rows.select("key", F.lit(True).alias("own")), "key", "left").agg(F.count("*").cast("int").alias("n"), F.every(F.col("own").isNotNull()).alias("member"))


@query("key_renamenx", "SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'now' ELSE o_orderpriority END AS key, o_orderkey AS member FROM orders")
def _(s, d):
    rows = keyspace.rename_if_free(zset(s, d).select("key", "member"), "1-URGENT", "now")
    return keyspace.rename_if_free(rows, "2-HIGH", "now")  # taken: nothing changes


@query("key_stick", f"WITH {KEYS} SELECT key, key LIKE '%1' AND key NOT LIKE '%11' AS sticky FROM keys")
def _(s, d):
    rows = keys(s, d).select("key").withColumn("sticky", F.lit(False))
    rows = keyspace.stick(rows, rows.where("key LIKE '%1'"))
    return keyspace.stick(rows, rows.where("key LIKE '%11'"), on=False)


@query("key_dump", f"WITH {TURNS} SELECT key, '[' || string_agg('{{\"pos\":' || pos || ',\"value\":\"' || value || '\"}}', ',' ORDER BY pos, value) || ']' AS dump FROM turns WHERE key IS NOT NULL AND value IS NOT NULL AND pos IS NOT NULL GROUP BY key")
def _(s, d):
    return keyspace.dump(turns(s, d).where("key IS NOT NULL AND value IS NOT NULL AND pos IS NOT NULL"))


# ----------------------------------------------------------------------------- geo


@query("geo_store", f"WITH {PLACES} SELECT 'near' AS key, member FROM places WHERE {metres('10', '20')} <= 3000000 UNION ALL SELECT key, member FROM places")
def _(s, d):
    rows = places(s, d)
    return geo.store(rows, geo.within_radius(rows, 10.0, 20.0, 3000, "km"), "near").select("key", "member")


@query("geo_store_distances", f"WITH {PLACES} SELECT 'near' AS key, member, round({metres('10', '20')} / 1000, 3) AS score FROM places WHERE {metres('10', '20')} <= 3000000")
def _(s, d):
    found = geo.store_distances(geo.within_radius(places(s, d), 10.0, 20.0, 3000, "km"), "near")
    return found.withColumn("score", F.round("score", 3))


# ----------------------------------------------------------------------------- streams

#: Two groups read every stream: g0 has the even entries pending, g1 those that are divisible by five.
GP = f"{X}, gp AS (SELECT key, ms, seq, g AS \"group\", 'c' || (user_id % 3) AS consumer FROM x, (VALUES ('g0', 2), ('g1', 5)) v(g, k) WHERE seq % k = 0)"


def group_pending(s: SparkSession, d: str) -> DataFrame:
    e = entries(s, d).select("key", "ms", "seq", F.concat(F.lit("c"), F.col("user_id") % 3).alias("consumer"))
    return e.where("seq % 2 = 0").withColumn("group", F.lit("g0")).unionByName(e.where("seq % 5 = 0").withColumn("group", F.lit("g1")))


@query("x_del", f"WITH {X} SELECT key, ms, seq FROM x WHERE seq % 4 <> 0")
def _(s, d):
    e = entries(s, d).select("key", "ms", "seq")
    return streams.delete(e, e.where("seq % 4 = 0"))


for _policy, _kept, _held in (("KEEPREF", "seq % 3 <> 0", "true"), ("DELREF", "seq % 3 <> 0", "seq % 3 <> 0"), ("ACKED", "NOT (seq % 3 = 0 AND seq % 2 <> 0 AND seq % 5 <> 0)", "true")):

    def _deleted(policy: str):
        def plan(s, d):
            e = entries(s, d).select("key", "ms", "seq")
            left, held = streams.delete_entries(e, group_pending(s, d), e.where("seq % 3 = 0"), policy)
            return left.groupBy("key").agg(F.count("*").alias("n")).join(held.groupBy("key").agg(F.count("*").alias("pending")), "key")

        return plan

    query(f"x_delex_{_policy.lower()}", f"WITH {GP} SELECT key, n, pending FROM (SELECT key, count(*) AS n FROM x WHERE {_kept} GROUP BY 1) JOIN (SELECT key, count(*) AS pending FROM gp WHERE {_held} GROUP BY 1) USING (key)")(_deleted(_policy))


@query("x_ackdel", f"WITH {GP} SELECT key, n, pending FROM (SELECT key, count(*) AS n FROM x WHERE NOT (seq % 3 = 0 AND seq % 5 <> 0) GROUP BY 1) JOIN (SELECT key, count(*) AS pending FROM gp WHERE NOT (\"group\" = 'g0' AND seq % 3 = 0) GROUP BY 1) USING (key)")
def _(s, d):
    e = entries(s, d).select("key", "ms", "seq")
    left, held = streams.acknowledge_and_delete(e, group_pending(s, d), "g0", e.where("seq % 3 = 0"), "ACKED")
    return left.groupBy("key").agg(F.count("*").alias("n")).join(held.groupBy("key").agg(F.count("*").alias("pending")), "key")


@query("x_nack", f"WITH {P} SELECT key, ms, seq, CASE WHEN seq % 3 <> 0 THEN consumer END AS consumer, CASE WHEN seq % 3 = 0 THEN 0 ELSE delivery_ms END AS delivery_ms, CAST(CASE WHEN seq % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS delivery_count FROM p")
def _(s, d):
    rows = pending(s, d)
    return streams.give_back(rows, rows.where("seq % 3 = 0"), "SILENT")


@query("x_nack_fatal", f"WITH {P} SELECT key, seq, CASE WHEN seq % 3 = 0 THEN 9223372036854775807 ELSE 1 END AS delivery_count FROM p")
def _(s, d):
    rows = pending(s, d)
    return streams.give_back(rows, rows.where("seq % 3 = 0"), "FATAL").select("key", "seq", "delivery_count")


@query("x_info_stream", f"WITH {X} SELECT key, count(*) AS length, min(ms) AS first_ms, max(ms) AS last_ms FROM x GROUP BY key")
def _(s, d):
    return streams.stream_info(entries(s, d)).select("key", "length", "first_ms", "last_ms")


@query("x_info_groups", f"WITH {GP}, g AS (SELECT DISTINCT key, \"group\", (SELECT (epoch_us(min(ts)) // 1000) FROM events) + 864000000 AS last_ms FROM gp), h AS (SELECT key, \"group\", count(DISTINCT consumer) AS consumers, count(*) AS pending FROM gp GROUP BY 1, 2), l AS (SELECT g.key, g.\"group\", count(x.seq) AS lag FROM g LEFT JOIN x ON x.key = g.key AND x.ms > g.last_ms GROUP BY 1, 2) SELECT key, \"group\", consumers, pending, lag FROM h JOIN l USING (key, \"group\")")
def _(s, d):
    at = span(s, d)[0] + 864_000_000
    groups = group_pending(s, d).select("key", "group").distinct().withColumn("last_ms", F.lit(at)).withColumn("last_seq", F.lit(1 << 62))
    return streams.group_info(entries(s, d), groups, group_pending(s, d)).select("key", "group", "consumers", "pending", "lag")


@query("x_setid", f"WITH {X}, m AS (SELECT key, max(ms) AS last_ms, count(*) AS entries_added FROM x GROUP BY key) SELECT key, CASE WHEN key = 'click' THEN last_ms + 5 ELSE last_ms END AS last_ms, entries_added FROM m")
def _(s, d):
    meta = entries(s, d).groupBy("key").agg(F.max("ms").alias("last_ms"), F.count("*").alias("entries_added"))
    new = meta.where("key = 'click'").select("key", (F.col("last_ms") + 5).alias("last_ms"), F.lit(None).cast("long").alias("entries_added"))
    return streams.set_id(meta, new)


@query("x_cfgset", f"WITH {X} SELECT DISTINCT key, CASE WHEN key = 'view' THEN 500 ELSE 100 END AS duration_ms, 100 AS max_size FROM x")
def _(s, d):
    config = entries(s, d).select("key").distinct().select("key", F.lit(100).alias("duration_ms"), F.lit(100).alias("max_size"))
    return streams.configure(config, config.where("key = 'view'").select("key", F.lit(500).alias("duration_ms"), F.lit(None).cast("int").alias("max_size")))


@query("x_idmp_record", f"WITH {X} SELECT key, user_id AS producer, seq % 7 AS token, min(seq) AS seq FROM (SELECT x.*, min(ms) OVER (PARTITION BY key, user_id, seq % 7) AS first_ms FROM x) WHERE ms = first_ms GROUP BY 1, 2, 3")
def _(s, d):
    rows = entries(s, d).select("key", F.col("user_id").alias("producer"), (F.col("seq") % 7).alias("token"), "ms", "seq")
    return streams.record_producer(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")).drop("ms")


@query("x_pending_range", f"WITH {P}, r AS (SELECT *, {END} - delivery_ms AS idle_ms, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS n FROM p WHERE {END} - delivery_ms >= 864000000 AND consumer = 'c1') SELECT key, ms, seq, idle_ms FROM r WHERE n <= 10")
def _(s, d):
    return streams.pending_range(pending(s, d), span(s, d)[1], 864_000_000, (0, 0), (1 << 61, 1 << 61), 10, "c1").select("key", "ms", "seq", "idle_ms")


# ----------------------------------------------------------------------------- vector sets, vectors

VS = "v AS (SELECT 'set' || label AS key, vec_id AS elem, embedding, '{\"n\":' || vec_id || '}' AS attrs FROM embeddings)"


def vector_set(s: SparkSession, d: str) -> DataFrame:
    attrs = F.concat(F.lit('{"n":'), F.col("vec_id"), F.lit("}"))
    return table(s, d, "embeddings").select(F.concat(F.lit("set"), "label").alias("key"), F.col("vec_id").alias("elem"), "embedding", attrs.alias("attrs"))


@query("vset_add_rem", f"WITH {VS} SELECT key, elem, attrs FROM v WHERE elem % 3 <> 0 AND elem % 5 <> 0 UNION ALL SELECT key, elem, 'new' FROM v WHERE elem % 5 = 0")
def _(s, d):
    rows = vector_set(s, d)
    rows = vectors.remove(rows, rows.where("elem % 3 = 0"))
    return vectors.put(rows, vector_set(s, d).where("elem % 5 = 0").withColumn("attrs", F.lit("new"))).drop("embedding")


@query("vset_ismember_emb", f"WITH {VS}, a AS (SELECT 'set' || l AS key, e AS elem FROM range(0, 3) x(l), range(0, 40) y(e)) SELECT a.key, a.elem, v.elem IS NOT NULL AS is_member, round(CAST(v.embedding[1] AS DOUBLE), 6) AS first_value, v.attrs FROM a LEFT JOIN v ON a.key = v.key AND a.elem = v.elem")
def _(s, d):
    asked = s.range(40).select(F.explode(F.array(*(F.lit(f"set{i}") for i in range(3)))).alias("key"), F.col("id").alias("elem"))
    got = vectors.look_up(vector_set(s, d), asked, "embedding", "attrs")
    return got.select("key", "elem", "is_member", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"), "attrs")


@query("vset_setattr", f"WITH {VS} SELECT key, elem, CASE WHEN elem % 2 = 0 THEN NULL ELSE 'a' END AS attrs FROM v")
def _(s, d):
    rows = vector_set(s, d)
    return vectors.set_attributes(rows, rows.select("key", "elem", F.when(F.col("elem") % 2 == 0, "").otherwise("a").alias("attrs"))).drop("embedding")


@query("vset_randmember", f"WITH {VS} SELECT key, least(3, count(*)) AS n, true AS members FROM v GROUP BY key")
def _(s, d):
    rows = vector_set(s, d)
    drawn = vectors.random_members(rows, 3, seed=4).join(rows.select("key", "elem", F.lit(True).alias("own")), ["key", "elem"], "left")
    return drawn.groupBy("key").agg(F.countDistinct("elem").alias("n"), F.every(F.col("own").isNotNull()).alias("members"))


@query("vset_links", f"WITH qs AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE label = 1), x AS (SELECT query_id, e.vec_id, {DIST['cosine']} AS dist FROM embeddings e, qs WHERE e.vec_id <> query_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM x) SELECT query_id, rank, vec_id FROM r WHERE rank <= 4")
def _(s, d):
    rows = table(s, d, "embeddings")
    return vectors.neighbours_of(rows, rows.where("label = 1").select("vec_id"), 4).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id")


@query("vector_decode", "SELECT vec_id, len(embedding) AS n, round(CAST(embedding[1] AS DOUBLE), 5) AS first_value FROM embeddings")
def _(s, d):
    text = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("string")), ", "), F.lit("]"))
    found = table(s, d, "embeddings").select("vec_id", vectors.decoded(text.cast("binary"), "FLOAT32", 64).alias("v"))
    return found.select("vec_id", F.size("v").cast("long").alias("n"), F.round(F.col("v")[0].cast("double"), 5).alias("first_value"))


@query("vector_code_search")
def _(s, d):
    rows = table(s, d, "embeddings")
    books = vectors.product_codebooks(rows, 4, 8)
    asked = [float(x) for x in rows.where("vec_id = 0").first()["embedding"]]
    return vectors.code_distances(vectors.product_codes(rows, books), books, asked).orderBy("distance", "vec_id").limit(20)


CACHE = "c AS (SELECT 'ns' || (label % 2) AS ns, vec_id AS entry_id, label, CASE WHEN vec_id % 4 = 0 THEN 1000 + vec_id END AS expire_at FROM embeddings)"


def cache(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.concat(F.lit("ns"), (F.col("label") % 2)).alias("ns"), F.col("vec_id").alias("entry_id"), "label", F.when(F.col("vec_id") % 4 == 0, 1000 + F.col("vec_id")).alias("expire_at"))


@query("semantic_set_del", f"WITH {CACHE} SELECT ns, entry_id, CASE WHEN entry_id % 7 = 0 THEN -1 ELSE label END AS label, expire_at FROM c WHERE entry_id % 5 <> 0 OR entry_id % 7 = 0")
def _(s, d):
    rows = vectors.cache_delete(cache(s, d), cache(s, d).where("entry_id % 5 = 0"))
    return vectors.cache_put(rows, cache(s, d).where("entry_id % 7 = 0").withColumn("label", F.lit(-1)))


@query("semantic_flush", f"WITH {CACHE} SELECT ns, entry_id FROM c WHERE ns <> 'ns0'")
def _(s, d):
    return vectors.cache_flush(cache(s, d), "ns0").select("ns", "entry_id")


@query("semantic_info", f"WITH {CACHE}, l AS (SELECT 'ns' || (user_id % 2) AS ns, event_type = 'click' AS hit, 10 AS tokens FROM events), a AS (SELECT ns, count(*) AS entries FROM c WHERE expire_at IS NULL OR expire_at > 1200 GROUP BY 1) SELECT ns, entries, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, CAST(sum(CASE WHEN hit THEN tokens ELSE 0 END) AS BIGINT) AS tokens_saved FROM a JOIN l USING (ns) GROUP BY ns, entries")
def _(s, d):
    asked = table(s, d, "events").select(F.concat(F.lit("ns"), F.col("user_id") % 2).alias("ns"), (F.col("event_type") == "click").alias("hit"), F.lit(10).alias("tokens"))
    return vectors.cache_info(cache(s, d), asked, 1200)


# ----------------------------------------------------------------------------- search


@query("ft_exact", f"WITH {ANALYZED} SELECT doc_id, round(sum(part), 6) AS score FROM scored WHERE term = 'version' GROUP BY 1")
def _(s, d):
    return rounded(index(s, d).exact("version"))


@query("ft_field_scope", f"WITH {ANALYZED} SELECT doc_id, round(sum(part), 6) AS score FROM scored WHERE term = 'license' AND doc_id IN (SELECT doc_id FROM documents WHERE source IS NOT NULL) GROUP BY 1")
def _(s, d):
    return rounded(search.scoped(index(s, d).term("license"), table(s, d, "documents"), "doc_id", "source"))


# ----------------------------------------------------------------------------- JSON


@query("json_strappend", "SELECT c_custkey AS key, c_name || '!' AS name, length(c_name) + 1 AS n FROM customer")
def _(s, d):
    doc = jsonops.edit("strappend", "$.name")(F.col("doc"), F.lit('"!"'))
    return documents_of(s, d).select("key", F.get_json_object(doc, "$.name").alias("name"), jsonops.string_length(doc, "$.name").cast("long").alias("n"))


@query("json_arrpop", "SELECT c_custkey AS key, 1 AS n FROM customer")
def _(s, d):
    doc = jsonops.edit("arrpop", "$.tags")(F.col("doc"), F.lit(None).cast("string"))
    return documents_of(s, d).select("key", jsonops.array_length(doc, "$.tags").alias("n"))


@query("json_path_wildcard", "SELECT c_custkey AS key, '\"a\",\"' || c_mktsegment || '\"' AS every, '\"' || c_mktsegment || '\"' AS last, '\"a\"' AS cut FROM customer")
def _(s, d):
    found = lambda path: F.array_join(jsonops.find(path)(F.col("doc")), ",")
    return documents_of(s, d).select("key", found("$.tags[*]").alias("every"), found("$.tags[-1]").alias("last"), found("$.tags[0:1]").alias("cut"))


@query("json_nummultby", "SELECT c_custkey AS key, c_custkey * 3 AS n FROM customer")
def _(s, d):
    doc = jsonops.edit("nummultby", "$.n")(F.col("doc"), F.lit("3"))
    return documents_of(s, d).select("key", F.get_json_object(doc, "$.n").cast("long").alias("n"))


# ----------------------------------------------------------------------------- replicas, agents


@query("crdt_dump_merge", f"WITH {CR}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY physical_ms DESC, event_id DESC) AS k FROM c) SELECT key, value FROM r WHERE k = 1 AND NOT deleted")
def _(s, d):
    rows = replicas(s, d)
    return crdt.last_writer(crdt.merge(rows.where("node = 0"), crdt.dump(rows.where("node > 0"))))


@query("agent_mem_add", "WITH t AS (SELECT DISTINCT conv_id AS session, turn, text AS content FROM conversations WHERE conv_id IS NOT NULL), l AS (SELECT session, max(turn) AS last FROM t GROUP BY 1) SELECT session, turn, content FROM t UNION ALL SELECT session, last + n, 'note ' || n FROM l, range(1, 3) x(n)")
def _(s, d):
    rows = table(s, d, "conversations").where("conv_id IS NOT NULL").select(F.col("conv_id").alias("session"), "turn", F.lit("user").alias("role"), F.col("text").alias("content")).distinct().withColumn("tokens", agent.token_estimate(F.col("content")))
    new = rows.select("session").distinct().select("session", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("seq")).select("session", "seq", F.lit("user").alias("role"), F.concat(F.lit("note "), F.col("seq")).alias("content"), F.lit(None).cast("long").alias("tokens"))
    return agent.add_turns(rows, new).select("session", "turn", "content")


@query("agent_mem_info", "WITH t AS (SELECT DISTINCT conv_id AS session, turn, text AS content, greatest(1, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT)) AS tokens FROM conversations WHERE text IS NOT NULL) SELECT session, count(*) AS total_turns, count(*) FILTER (turn > 2) AS active_turns, CAST(sum(CASE WHEN turn > 2 THEN tokens ELSE 0 END) AS BIGINT) AS active_tokens FROM t GROUP BY 1")
def _(s, d):
    rows = table(s, d, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("session"), "turn", F.col("text").alias("content")).distinct()
    return agent.memory_info(rows.withColumn("tokens", agent.token_estimate(F.col("content"))).withColumn("compacted", F.col("turn") <= 2))


@query("agent_mem_clear", "SELECT DISTINCT conv_id AS session FROM conversations WHERE conv_id % 2 = 1")
def _(s, d):
    rows = table(s, d, "conversations").where("conv_id IS NOT NULL").select(F.col("conv_id").alias("session"), "turn")
    return agent.clear_memory(rows, rows.where("session % 2 = 0").distinct()).select("session").distinct()


PUTS = "n AS (SELECT user_id AS thread, event_type AS step_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events), nodes AS (SELECT thread, step_id, max(seq) AS seq, arg_max(event_id, seq) AS state FROM n GROUP BY 1, 2)"


def checkpoint_puts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("user_id").alias("thread"), F.col("event_type").alias("step_id"), F.col("event_id").alias("put_no"), F.col("event_id").alias("state"))


@query("agent_checkpoint_put", f"WITH {PUTS} SELECT thread, step_id, seq, state, seq = max(seq) OVER (PARTITION BY thread) AS head FROM nodes")
def _(s, d):
    return agent.checkpoints(checkpoint_puts(s, d))


@query("agent_checkpoint_get", f"WITH {PUTS}, h AS (SELECT thread, step_id, state, seq = max(seq) OVER (PARTITION BY thread) AS head FROM nodes) SELECT thread, step_id, state FROM h WHERE (thread % 2 = 0 AND head) OR (thread % 2 = 1 AND step_id = 'click')")
def _(s, d):
    nodes = agent.checkpoints(checkpoint_puts(s, d))
    asked = nodes.select("thread").distinct().select("thread", F.when(F.col("thread") % 2 == 1, "click").alias("step_id"))
    return agent.checkpoint(nodes, asked).select("thread", "step_id", "state")


@query("tool_states", "WITH RECURSIVE e AS (SELECT user_id AS k, event_id, event_type = 'purchase' AS done, (epoch_us(ts) // 1000) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS i FROM events), w AS (SELECT k, event_id, i, done AS finished, CASE WHEN NOT done THEN ms + 3600000 END AS until, CASE WHEN NOT done THEN 'claimed' END AS state FROM e WHERE i = 1 UNION ALL SELECT e.k, e.event_id, e.i, e.done OR w.finished, CASE WHEN e.done OR w.finished THEN NULL WHEN w.until IS NOT NULL AND e.ms < w.until THEN w.until ELSE e.ms + 3600000 END, CASE WHEN e.done THEN NULL WHEN w.finished THEN 'completed' WHEN w.until IS NOT NULL AND e.ms < w.until THEN 'in_progress' ELSE 'claimed' END FROM e JOIN w ON e.k = w.k AND e.i = w.i + 1) SELECT event_id, state FROM w")
def _(s, d):
    rows = table(s, d, "events").select("event_id", F.col("user_id").alias("call_id"), F.expr(MILLIS_SQL).alias("ts_ms"), F.when(F.col("event_type") == "purchase", "complete").otherwise("claim").alias("op"), F.when(F.col("event_type") != "purchase", F.lit(3_600_000)).alias("ttl_ms"))
    return agent.tool_states(rows, "call_id", "ts_ms", "event_id").select("event_id", "state")


@query("llm_quota_decisions")
def _(s, d):
    rows = table(s, d, "events").select("event_id", F.col("user_id").alias("key"), F.expr(MILLIS_SQL).alias("ts_ms"), F.lit("reserve").alias("op"), F.col("event_id").alias("call"), (F.col("event_id") % 500).alias("tokens"))
    return agent.quota_decisions(rows, 2, 600, 86_400_000, "key", "ts_ms", "event_id").select("event_id", "allowed", "remaining")


@query("cuckoo_addnx", "SELECT event_type AS key, count(DISTINCT user_id) AS items FROM events GROUP BY 1")
def _(s, d):
    rows = table(s, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("item")).distinct()
    held = sketches.cuckoo(rows.where("item % 2 = 0").withColumn("delta", F.lit(1)))
    return sketches.cuckoo_info(sketches.cuckoo_add_new(held, rows)).select("key", "items")


@query("geo_cells", f"WITH {PLACES} SELECT member, round({metres('10', '20')} / 1000, 3) AS distance FROM places WHERE {metres('10', '20')} <= 3000000")
def _(s, d):
    rows = places(s, d).withColumn("cell", geohash52(F.col("lon"), F.col("lat")))
    return geo.within_cells(rows, 10.0, 20.0, 3000, "km").select("member", F.round("distance", 3).alias("distance"))


@query("x_readgroup", f"WITH {X}, g AS (SELECT key, min(ms) + 86400000 AS last_ms FROM x GROUP BY key), n AS (SELECT x.key, x.ms, x.seq, row_number() OVER (PARTITION BY x.key ORDER BY x.ms, x.seq) - 1 AS i FROM x JOIN g USING (key) WHERE x.ms > last_ms) SELECT key, ms, seq, 'consumer' || (i % 3) AS consumer FROM n")
def _(s, d):
    e = entries(s, d)
    groups = e.groupBy("key").agg((F.min("ms") + 86_400_000).alias("last_ms")).withColumn("group", F.lit("g")).withColumn("last_seq", F.lit(1 << 62))
    return streams.read_group(e.select("key", "ms", "seq"), groups, 3, AS_OF)[0].select("key", "ms", "seq", "consumer")
