"""Conditional writes, deletes, folds and typed vectors on small fixtures."""

from __future__ import annotations

import random
import struct

from pyspark.sql import Window
from pyspark.sql import functions as F

from keyframe.functions.columns import byte_range, overwrite
from keyframe.operators import agent, bitmaps, blocks, geo, hashes, jsonops, keyspace, leases, lists, streams, strings, vectors, zsets


def rows(df):
    return sorted(tuple(r) for r in df.collect())


STORE = "key string, value string, expire_at long"


def test_conditional_writes(spark):
    store = spark.createDataFrame([("a", "1", 50), ("b", "2", None)], STORE)
    new = spark.createDataFrame([("a", "x", 90), ("c", "y", None)], STORE)
    assert rows(strings.set_many(store, new)) == [("a", "x", 90, "1"), ("b", "2", None, None), ("c", "y", None, None)]
    assert rows(strings.set_many(store, new, "NX").drop("old")) == [("a", "1", 50), ("b", "2", None), ("c", "y", None)]
    assert rows(strings.set_many(store, new, "XX", keep_ttl=True).drop("old")) == [("a", "x", 50), ("b", "2", None)]
    compare = new.withColumn("compare", F.lit("1"))
    assert rows(strings.set_many(store, compare, "IFEQ").drop("old")) == [("a", "x", 90), ("b", "2", None)]
    assert rows(strings.set_all(store, new, "NX")) == rows(store) == rows(strings.set_all(store, new, "XX"))
    assert len(rows(strings.set_all(store, new.where("key = 'c'"), "NX"))) == 3
    assert rows(strings.set_many(store.limit(0), new.limit(0))) == []


def test_deletes_and_expiry(spark):
    store = spark.createDataFrame([("a", "1", 50), ("b", "2", None), ("c", None, 7)], STORE)
    asked = spark.createDataFrame([("a",), ("z",)], "key string")
    got, left = strings.get_and_delete(store.select("key", "value"), asked)
    assert rows(got) == [("a", "1"), ("z", None)] and [r[0] for r in rows(left)] == ["b", "c"]
    values, after = strings.get_and_expire(store, asked.withColumn("at", F.lit(None).cast("long")))
    assert rows(values) == [("a", "1"), ("z", None)] and dict((r["key"], r["expire_at"]) for r in after.collect()) == {"a": None, "b": None, "c": 7}
    wanted = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "key string, value string")
    kept = lambda c, w=wanted: [r[0] for r in rows(strings.delete_if(store, w, c).select("key"))]
    assert kept("IFEQ") == ["b", "c"] and kept("IFNE") == ["a"]
    digests = wanted.withColumn("value", strings.value_digest(F.col("value")))
    assert kept("IFDEQ", digests) == ["b", "c"] and kept("IFDNE", digests) == ["a"]


def test_bytes(spark):
    df = spark.createDataFrame([("héllo",)], "v string")
    (a, b, c) = df.select(byte_range(F.col("v"), 1, 2), overwrite(F.col("v"), 1, "é"), overwrite(F.col("v"), 8, "x")).first()
    assert (a, b, c) == ("é", "héllo", "héllo\0\0x")


def test_common_subsequence(spark):
    df = spark.createDataFrame([("ohmytext", "mynewtext"), ("", "x"), (None, "x")], "a string, b string")
    found = [tuple(r) for r in df.select(strings.common_length(F.col("a"), F.col("b")), strings.common_ranges(F.col("a"), F.col("b"))).collect()]
    assert found[0][0] == 6 and [tuple(m) for m in found[0][1]] == [(4, 7, 5, 8, 4), (2, 3, 0, 1, 2)]
    assert found[1:] == [(0, []), (None, None)]


def test_hash_writes(spark):
    schema = "key string, field string, value string, expire_at long"
    store = spark.createDataFrame([("h", "a", "1", 5), ("h", "b", "2", None)], schema)
    new = spark.createDataFrame([("h", "a", "9", 7), ("h", "c", "3", None), ("g", "a", "4", 1)], schema)
    assert rows(hashes.set_fields_expiring(store, new, "FNX")) == [("g", "a", "4", 1), ("h", "a", "1", 5), ("h", "b", "2", None)]
    assert rows(hashes.set_fields_expiring(store, new, "FXX")) == rows(store)
    assert len(rows(hashes.set_fields_expiring(store, new))) == 4
    assert rows(hashes.persist_fields(store, new.select("key", "field"))) == [("h", "a", "1", None), ("h", "b", "2", None)]
    page = hashes.scan_fields(store.select("key", "field"), -(1 << 63), 1)
    rest = hashes.scan_fields(store.select("key", "field"), page.first()["slot"], 10)
    assert sorted(r["field"] for r in page.union(rest).collect()) == ["a", "b"] and page.count() == 1


def test_keys(spark):
    k = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("b", 1, 3)], "key string, db int, v int")
    asked = spark.createDataFrame([("a", 1), ("b", 1)], "key string, db int")
    assert rows(keyspace.move_to(k, asked, 0)) == [("a", 0, 1), ("a", 1, 2), ("b", 0, 3)]
    assert rows(keyspace.move_to(k, asked, 0, replace=True)) == [("a", 0, 2), ("b", 0, 3)]
    assert rows(keyspace.rename_if_free(k, "b", "a")) == rows(k)


def test_first_with_rows(spark):
    z = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)], "key string, member string, score double")
    popped, rest = zsets.pop_first(z, ["none", "a", "b"])
    assert rows(popped) == [("a", "x", 1.0)] and rows(rest) == [("a", "y", 2.0), ("b", "x", 3.0)]
    popped, rest = lists.pop_first(spark.createDataFrame([("l", 1, "v")], "key string, pos int, value string"), ["none"])
    assert rows(popped) == [] and rows(rest) == [("l", 1, "v")]
    assert rows(zsets.replace(z, zsets.combine(z, ["a", "b"], "inter"), "c")) == [*rows(z), ("c", "x", 4.0)]


def test_stream_deletes(spark):
    e = spark.createDataFrame([("s", i, 0) for i in range(1, 5)], "key string, ms long, seq long")
    p = spark.createDataFrame([("s", 1, 0, "g", "c", 10, 2), ("s", 2, 0, "h", "c", 10, 1)], "key string, ms long, seq long, group string, consumer string, delivery_ms long, delivery_count long")
    gone = e.where("ms <= 3")
    for policy, left, held in (("KEEPREF", [4], 2), ("DELREF", [4], 0), ("ACKED", [1, 2, 4], 2)):
        entries, pending = streams.delete_entries(e, p, gone, policy)
        assert [r[1] for r in rows(entries)] == left and pending.count() == held
    entries, pending = streams.acknowledge_and_delete(e, p, "g", gone, "ACKED")
    assert [r[1] for r in rows(entries)] == [2, 4] and pending.count() == 1
    back = {m: rows(streams.give_back(p, gone.where("ms = 1"), m))[0][3:] for m in ("SILENT", "FAIL", "FATAL")}
    assert back == {"SILENT": (None, 0, 1), "FAIL": (None, 0, 2), "FATAL": (None, 0, (1 << 63) - 1)}


def test_bitfields(spark):
    bits = bitmaps.set_field(spark.createDataFrame([("k", 0)], "key string, offset long"), 4, 8, spark.createDataFrame([("k", -3), ("n", 200)], "key string, value long"))
    assert rows(bitmaps.field_value(bits, 4, 8)) == [("k", -3), ("n", -56)]
    assert rows(bitmaps.field_value(bits, 4, 8, signed=False)) == [("k", 253), ("n", 200)] and ("k", 0) in rows(bits)


def test_typed_vectors(spark):
    cases = [(struct.pack("<2f", 1.5, -2), "FLOAT32", [1.5, -2.0]), (struct.pack("<2d", 1.5, 4), "FLOAT64", [1.5, 4.0]), (struct.pack("<2e", 0.5, 2), "FLOAT16", [0.5, 2.0]), (b"\x80\x3f\x00\xc0", "BFLOAT16", [1.0, -2.0]),
             (b"\x01\xff", "INT8", [1.0, -1.0]), (b"\x01\xff", "UINT8", [1.0, 255.0]), (b"[1, 2.5]", "FLOAT32", [1.0, 2.5]), (b"1,2,3", "FLOAT32", None), (b"", "FLOAT32", None), (struct.pack("<2f", 1, float("nan")), "FLOAT32", None), (None, "FLOAT32", None)]
    for data, kind, want in cases:
        got = spark.createDataFrame([(data,)], "b binary").select(vectors.decoded(F.col("b"), kind, 2)).first()[0]
        assert got == want, (data, kind)


def test_vector_sets(spark):
    v = spark.createDataFrame([("s", "a", [1.0], "x"), ("s", "b", [2.0], None)], "key string, elem string, embedding array<double>, attrs string")
    new = spark.createDataFrame([("s", "a", [9.0], None), ("s", "c", [3.0], "y")], v.schema)
    assert rows(vectors.put(v, new).select("elem", F.col("embedding")[0])) == [("a", 9.0), ("b", 2.0), ("c", 3.0)]
    assert rows(vectors.set_attributes(v, spark.createDataFrame([("s", "a", ""), ("s", "b", "z")], "key string, elem string, attrs string")).select("elem", "attrs")) == [("a", None), ("b", "z")]
    got = vectors.look_up(v, spark.createDataFrame([("s", "b"), ("s", "q")], "key string, elem string"), "attrs")
    assert rows(got) == [("s", "b", None, True), ("s", "q", None, False)]


def test_tool_states(spark):
    log = [("t", 0, "claim", 60), ("t", 40, "claim", 60), ("t", 80, "claim", 60), ("t", 90, "complete", 100), ("t", 150, "claim", 60), ("t", 190, "claim", 60), ("u", 5, "complete", None), ("u", 9999, "claim", 1)]
    df = spark.createDataFrame(log, "call_id string, ts_ms long, op string, ttl_ms long").repartition(3)
    got = sorted((r["call_id"], r["ts_ms"], r["state"], r["attempt"]) for r in agent.tool_states(df).collect())
    assert got == [("t", 0, "claimed", 1), ("t", 40, "in_progress", None), ("t", 80, "claimed", 2), ("t", 90, None, None), ("t", 150, "completed", None), ("t", 190, "claimed", 1), ("u", 5, None, None), ("u", 9999, "completed", None)]


def test_quota_decisions(spark):
    log = [("k", 0, "reserve", 1, 700), ("k", 1, "reserve", 2, 500), ("k", 2, "settle", 1, 400), ("k", 3, "reserve", 3, 500), ("k", 70_000, "reserve", 4, 900)]
    df = spark.createDataFrame(log, "key string, ts_ms long, op string, call long, tokens long")
    got = sorted((r["ts_ms"], r["allowed"], r["remaining"]) for r in agent.quota_decisions(df, 2, 1000, 60_000).collect())
    assert got == [(0, True, 300), (1, False, 300), (2, True, 600), (3, True, 100), (70_000, True, 100)]


def test_quota_against_a_plain_fold(spark):
    rng = random.Random(1)
    log = [(rng.choice("ab"), rng.randrange(2000), "reserve", i, rng.randrange(1, 60)) for i in range(300)]
    want, held = {}, {}
    for k, t, _, i, n in sorted(log, key=lambda r: (r[1], r[3])):
        held[k] = [c for c in held.get(k, []) if c[0] > t - 100]
        want[i] = len(held[k]) < 4 and sum(c[1] for c in held[k]) + n <= 120
        if want[i]:
            held[k].append((t, n))
    df = spark.createDataFrame(log, "key string, ts_ms long, op string, call long, tokens long").repartition(4)
    assert {r["call"]: r["allowed"] for r in agent.quota_decisions(df, 4, 120, 100, "key", "ts_ms", "call").collect()} == want


def test_checkpoints(spark):
    puts = spark.createDataFrame([("t", 1, "root", None, "s1"), ("t", 2, "a", "root", "s2"), ("t", 3, "root", None, "s3")], "thread string, put_no long, step_id string, parent_id string, state string")
    nodes = agent.checkpoints(puts)
    assert sorted((r["step_id"], r["seq"], r["state"], r["head"]) for r in nodes.collect()) == [("a", 2, "s2", False), ("root", 3, "s3", True)]
    asked = spark.createDataFrame([("t", None), ("t", "a"), ("t", "none")], "thread string, step_id string")
    assert sorted(r["state"] for r in agent.checkpoint(nodes, asked).collect()) == ["s2", "s3"]


def test_lineages_side_by_side(spark):
    a = agent.lineage(spark, spark.createDataFrame([("b", "a"), ("a", None)], "step_id string, parent_id string"), "b")
    b = agent.lineage(spark, spark.createDataFrame([("y", "x"), ("x", "y")], "step_id string, parent_id string"), "y")
    assert [r["step_id"] for r in a.orderBy("depth").collect()] == ["b", "a"] and [r["step_id"] for r in b.orderBy("depth").collect()] == ["y", "x"]


def test_json_paths(spark):
    doc = '{"a": [1, {"b": 2}, 3], "c": {"d": "x", "e": null}}'
    for path, want in {"$.a[*]": ["1", '{"b":2}', "3"], "$.a[-1]": ["3"], "$.a[1:]": ['{"b":2}', "3"], "$.a[*].b": ["2"], "$.c.*": ['"x"', "null"], '$["c"].d': ['"x"'], "$.z": [], "$": ['{"a":[1,{"b":2},3],"c":{"d":"x","e":null}}']}.items():
        df = spark.createDataFrame([(doc,), ("no json",), (None,)], "doc string")
        assert [r[0] for r in df.select(jsonops.find(path)(F.col("doc"))).collect()] == [want, None, None], path


def test_folds_keep_keys_apart(spark):
    df = spark.createDataFrame([(None, 1, 0), ("a", 1, 0), ("a", 1, 50), ("a", 2, 60), ("a", 1, 100), (None, 1, 10)], "k string, n int, t long").repartition(4)
    got = sorted((r["k"] or "", r["n"], r["t"], r["ok"]) for r in leases.opens_window(df, ["k", "n"], "t", 60, "ok").collect())
    assert got == [("", 1, 0, True), ("", 1, 10, False), ("a", 1, 0, True), ("a", 1, 50, False), ("a", 1, 100, True), ("a", 2, 60, True)]


def test_running_values_in_blocks(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", None]), i * 3 + rng.randrange(2), rng.randrange(50), i) for i in range(200)]
    df = spark.createDataFrame(data, "k string, t long, v long, i long").repartition(4)
    window = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, -1)
    for fold, merge in ((F.max, None), (F.min, None), (F.sum, None), (F.count, F.sum)):
        want = {r["i"]: r["x"] or None for r in df.withColumn("x", fold("v").over(window)).collect()}
        assert {r["i"]: r["x"] or None for r in blocks.before(df, ["k"], "t", 40, "x", F.col("v"), fold, merge, "i").collect()} == want
    span = Window.partitionBy("k").orderBy("t").rangeBetween(-24, 0)
    want = {r["i"]: (r["n"], r["s"]) for r in df.withColumn("n", F.count("*").over(span)).withColumn("s", F.sum("v").over(span)).collect()}
    assert {r["i"]: (r["n"], r["s"]) for r in blocks.within_time(df, ["k"], "t", 25, n=F.count("*"), s=F.sum("v")).collect()} == want


def test_cells_cover_circles(spark):
    rng = random.Random(3)
    points = spark.createDataFrame([("c", i, rng.uniform(-180, 180), rng.uniform(-84, 84)) for i in range(4000)], "key string, member long, lon double, lat double")
    from keyframe.functions.columns import geohash52

    celled = points.withColumn("cell", geohash52(F.col("lon"), F.col("lat"))).cache()
    for lon, lat, km in ((10.0, 20.0, 900), (179.9, -60.0, 1500), (0.0, 83.0, 700), (-180.0, 0.0, 4000), (5.0, 5.0, 15000)):
        want = sorted(r["member"] for r in geo.within_radius(points, lon, lat, km, "km").collect())
        assert len(geo.covering_cells(lon, lat, km * 1000)) <= 9
        assert sorted(r["member"] for r in geo.within_cells(celled, lon, lat, km, "km").collect()) == want, (lon, lat, km)


def test_groups_read_in_turn(spark):
    e = spark.createDataFrame([("s", i // 3, i) for i in range(10)], "key string, ms long, seq long")
    groups = spark.createDataFrame([("s", "g", 0, 1), ("s", "h", 99, 0)], "key string, group string, last_ms long, last_seq long")
    pending, moved = streams.read_group(e, groups, 2, 5)
    assert [r["consumer"] for r in pending.orderBy("ms", "seq").collect()] == [f"consumer{i % 2}" for i in range(8)]
    assert rows(moved) == [("s", "g", 3, 9), ("s", "h", 99, 0)]


def test_distances_of_product_codes(spark):
    rng = random.Random(4)
    data = [(i, [rng.random() for _ in range(6)]) for i in range(60)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    books = vectors.product_codebooks(df, 3, 4)
    codes = vectors.product_codes(df, books)
    asked = [rng.random() for _ in range(6)]
    got = {r["vec_id"]: r["distance"] for r in vectors.code_distances(codes, books, asked).collect()}
    for r in codes.collect():
        decoded = [float(x) for p, m in enumerate(books) for x in m.clusterCenters()[r[f"code_{p}"]]]
        assert abs(got[r["vec_id"]] - sum((a - b) ** 2 for a, b in zip(decoded, asked, strict=True))) < 1e-9
