"""Search, vectors, JSON, geo, sketches, replicas, streams and agents on small fixtures."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from keyframe.functions.columns import geohash_text, vector
from keyframe.functions.text import index_terms, tokens
from keyframe.operators import agent, crdt, geo, jsonops, pubsub, search, sketches, streams, vectors
from keyframe.operators.aggregate import Pipeline
from keyframe.sources.tables import append, compact, live, load_snapshot, replay, save_snapshot


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_pipeline(spark):
    sales = [("north", 100), ("north", 250), ("north", 150), ("south", 80), ("south", 120), ("east", 300), ("east", 400), ("west", 50), ("west", 150), ("west", 100)]
    df = spark.createDataFrame([(r, float(v)) for r, v in sales], "region string, revenue double")
    p = Pipeline(df).group_by(["region"], ("count", None, "n"), ("sum", "revenue", "sum_rev")).apply("sum_rev * 1.05", "rev_tax")
    top = p.sort_by(("rev_tax", True), limit=2).load("region", "rev_tax").rows
    assert [(r, round(x, 6)) for r, x in rows(top)] == [("east", 735.0), ("north", 525.0)]
    assert rows(Pipeline(df).group_by([], ("count", None, "n"), ("sum", "revenue", "s")).rows) == [(10, 1700.0)]
    assert rows(Pipeline(df.limit(0)).group_by([], ("count", None, "n")).rows) == []


def test_analyzer(spark):
    df = spark.createDataFrame([("The Parties were Running, classes; Étion glass boxes",), (None,), ("",)], "t string")
    assert rows(df.select(tokens(F.col("t")))) == [(["party", "runn", "class", "Étion", "glass", "box"],), ([],), ([],)]


def test_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "High performance Rust redis engine", 99.5, "database, rust, cache"), (2, "Dragonfly memory store in C++", 49.0, "database, memory")], "doc_id int, title string, price double, tags string")
    catalog = search.Catalog(spark, f"file://{tmp_path}/indexes")
    i = catalog.create("items", docs, "doc_id", "title")
    ids = lambda h: sorted(r["doc_id"] for r in h.collect())
    assert ids(i.term("rust")) == [1] and ids(i.prefix("redi")) == [1] and ids(i.negate(i.term("rust"))) == [2]
    assert ids(search.filtered(docs, "doc_id", F.col("price").between(50, 100))) == [1]
    assert ids(search.filtered(docs, "doc_id", search.tag("tags", ["memory"]))) == [2]
    assert ids(search.all_of(i.term("rust"), i.term("memory"))) == [] and ids(search.any_of(i.term("rust"), i.term("memory"))) == [1, 2]
    assert ids(i.term("Rusts")) == [1] and ids(i.exact("rusts")) == [] and ids(i.exact("rust")) == [1]
    priced = docs.withColumn("price", F.when(F.col("doc_id") == 1, F.col("price")))
    assert ids(search.scoped(search.any_of(i.term("rust"), i.term("memory")), priced, "doc_id", "price")) == [1]
    more = search.add_documents(docs, spark.createDataFrame([(2, "Plain store", 1.0, ""), (3, "Rust again", 2.0, "")], docs.schema), "doc_id")
    j = catalog.create("items", more, "doc_id", "title")
    assert ids(j.term("rust")) == [1, 3] and ids(j.term("memory")) == [] and ids(catalog.open("items").term("plain")) == [2]
    assert [tuple(r) for r in j.info().collect()] == [(3, 7, 8)] and catalog.names() == ["items"]
    catalog.drop("items")
    assert catalog.names() == []


def test_terms_of_scripts_with_vowel_signs(spark):
    df = spark.createDataFrame([(1, "हिन्दी भाषा, x2")], "doc_id int, t string")
    assert sorted(r["term"] for r in index_terms(df, "doc_id", "t").collect()) == sorted(["हिन", "दी", "भाषा", "x2"])


def test_bm25_value(spark, tmp_path):
    docs = spark.createDataFrame([(1, "apple pear"), (2, "plum fig"), (3, "kiwi lime")], "doc_id int, t string")
    (score,) = (r["score"] for r in search.Index.create(docs, "doc_id", "t", f"file://{tmp_path}/i").term("apple").collect())
    assert math.isclose(score, math.log(1 + 2.5 / 1.5), rel_tol=1e-9)


def test_rank_fusion(spark):
    make = lambda ids: spark.createDataFrame([(x, float(-i)) for i, x in enumerate(ids)], "doc_id string, score double")
    got = {r["doc_id"]: round(r["score"], 5) for r in search.rrf(make("ABC"), make("BD")).collect()}
    assert got == {"B": 0.03252, "A": 0.01639, "D": 0.01613, "C": 0.01587}


def test_nearest(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 0.0])], "vec_id int, embedding array<float>")
    assert vectors.nearest(v, vector([1, 0.1, 0]), 1, "cosine").first()["vec_id"] == 1
    assert rows(vectors.within(v, vector([1, 0, 0]), 1.0, "cosine").select("vec_id"), "vec_id") == [(1,), (2,), (3,)]  # a zero vector is at 1


def test_json(spark):
    df = spark.createDataFrame([('{"name":"Bob","age":28,"tags":["rust","io"],"online":true}',), ("not json",), (None,)], "doc string")
    none = F.lit(None).cast("string")
    assert rows(df.select(jsonops.get(F.col("doc"), "$.name"), jsonops.kind(F.col("doc"), "$.tags")))[0] == ("Bob", "array")
    assert rows(df.select(jsonops.get(jsonops.edit("numincrby", "$.age")(F.col("doc"), F.lit("2")), "$.age"))) == [("30",), (None,), (None,)]
    cut = jsonops.edit("arrpop", "$.tags")(jsonops.edit("toggle", "$.online")(F.col("doc"), none), none)
    assert rows(df.select(cut))[0] == ('{"age":28,"name":"Bob","online":false,"tags":["rust"]}',)
    assert rows(df.select(jsonops.edit("del", "$.tags[-1]")(F.col("doc"), none)))[1:] == [("not json",), (None,)]


def test_geo(spark):
    p = spark.createDataFrame([("k", "Palermo", 13.361389, 38.115556), ("k", "Catania", 15.087269, 37.502669)], "key string, member string, lon double, lat double")
    assert 166274 < geo.distance_between(p, "Palermo", "Catania").first()["distance"] < 166275
    assert rows(geo.closest(geo.within_radius(p, 15.0, 37.0, 200, "km"), 5).select("member")) == [("Catania",), ("Palermo",)]
    assert rows(geo.within_box(p, 15.0, 37.0, 400, 400, "km").select("member"), "member") == [("Catania",), ("Palermo",)]
    assert rows(p.select(geohash_text(F.col("lon"), F.col("lat"))))[0][0].startswith("sqc8b49rny")


def test_sketches(spark):
    assert sketches.bloom_size(1000, 0.01) == (9586, 7)
    items = spark.createDataFrame([("k", f"item{i}") for i in range(300)], "key string, item string")
    bits = sketches.bloom(items, "item", 9586, 7)
    other = spark.createDataFrame([("k", f"x{i}") for i in range(300)], "key string, item string")
    assert sketches.bloom_contains(bits, items, "item", 9586, 7).where("NOT found").count() == 0
    assert sketches.bloom_contains(bits, other, "item", 9586, 7).where("found").count() < 10
    n = spark.createDataFrame([("k", "item1", 42), ("k", "item2", 17)], "key string, item string, n long")
    got = sketches.cms_query(sketches.cms(n, "item", F.col("n"), 200, 5), spark.createDataFrame([("k", "item1"), ("k", "item2"), ("k", "no")], "key string, item string"), "item", 200, 5)
    assert rows(got, "item") == [("k", "item1", 42), ("k", "item2", 17), ("k", "no", 0)]


def test_replicas(spark):
    w = spark.createDataFrame([("k", "a", False, 5, 0, 1), ("k", "b", False, 5, 1, 0), ("g", "c", False, 1, 0, 0), ("g", "c", True, 2, 0, 0)], "key string, value string, deleted boolean, physical_ms long, logical int, node int")
    assert rows(crdt.last_writer(w)) == [("k", "b")]
    adds = spark.createDataFrame([("s", "x", 1), ("s", "x", 2), ("s", "y", 3)], "key string, member string, tag int")
    assert rows(crdt.observed_set(adds, adds.where("tag IN (1, 3)"))) == [("s", "x")]


def test_streams(spark):
    e = spark.createDataFrame([("s", 1, i) for i in range(4)], "key string, ms long, seq long")
    p = streams.deliver(e, 1, F.lit(0))
    got = streams.claim(p, "consumer2", 200, 10, count=1)
    assert rows(got.where("claimed").select("seq", "consumer", "delivery_count")) == [(0, "consumer2", 2)]
    assert streams.acknowledge(p, e.where("seq < 2")).count() == 2
    late = spark.createDataFrame([("s", 5, 0, 1), ("s", 4, 9, 2), ("s", 5, 1, 3)], "key string, ms long, seq long, at int")
    assert rows(streams.accepted(late, "at").select("at"), "at") == [(1,), (3,)]


def test_agents(spark):
    t = spark.createDataFrame([("s", 1, 12, [1.0, 0.0, 0.0]), ("s", 2, 10, [0.9, 0.1, 0.0]), ("s", 3, 10, [0.0, 1.0, 0.0]), ("s", 4, 10, [0.0, 0.9, 0.1])], "session string, turn int, tokens long, embedding array<double>")
    recent = agent.context_window(t, 20)
    assert rows(recent.select("turn"), "turn") == [(3,), (4,)]
    assert rows(agent.recall(t, recent, vector([1, 0, 0]), 2).select("turn"), "turn") == [(1,), (2,)]
    assert rows(agent.compact(t, 1, F.lit("x" * 32))) == [("s", 3, 2, 18)]
    steps = spark.createDataFrame([("root", None), ("step_a", "root"), ("step_b", "step_a"), ("loop", "loop")], "step_id string, parent_id string")
    assert [r[0] for r in rows(agent.lineage(spark, steps, "step_b"), "depth")] == ["step_b", "step_a", "root"]
    assert [r[0] for r in rows(agent.lineage(spark, steps, "loop"))] == ["loop"]


def fold_windows(rows, span):
    """Positions of the (key, time) rows that open a window, in order."""
    until, opened = {}, []
    for i, (key, t) in enumerate(rows):
        if t >= until.get(key, t):
            until[key] = t + span
            opened.append(i)
    return opened


def test_refused_claims_extend_nothing(spark):
    import random

    rng = random.Random(1)
    calls = sorted(((rng.randint(0, 3), 1000 * rng.randint(0, 900)) for _ in range(400)), key=lambda r: r[1])
    calls = [(9, 0), (9, 40_000), (9, 80_000), *calls]
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(calls)], "call_id long, ts_ms long, claim long").repartition(3)
    got = rows(agent.tool_claims(df, 60_000, "call_id", "ts_ms", "claim").where("granted").select("claim"), "claim")
    assert [r[0] for r in got] == fold_windows(calls, 60_000) and (0,) in got and (1,) not in got and (2,) in got
    entries = df.selectExpr("'s' AS key", "ts_ms AS ms", "claim AS seq", "call_id AS producer", "1 AS token")
    assert [r[0] for r in rows(streams.idempotent(entries, window_ms=60_000).select("seq"), "seq")] == fold_windows(calls, 60_000)


def test_pubsub(spark):
    m = spark.createDataFrame([("news.a", "1"), ("news.b", "2"), ("other", "3")], "channel string, payload string")
    assert rows(pubsub.subscribed(m, ["other"], ["news.?"]).select("payload"), "payload") == [("1",), ("2",), ("3",)]


def test_log_and_snapshot(spark, tmp_path):
    log = spark.createDataFrame([("a", 1, "set", "x"), ("a", 2, "set", "y"), ("b", 3, "set", "z"), ("b", 4, "del", None)], "key string, seq long, op string, value string")
    assert rows(compact(log, ["key"]).select("key", "value")) == [("a", "y")]
    append(log, str(tmp_path / "log"))
    append(log.where("seq = 1"), str(tmp_path / "log"))
    seen = []
    replay(spark, str(tmp_path / "log"), log.schema.simpleString()[7:-1].replace(":", " "), lambda df, _: seen.append(df.count()), str(tmp_path / "ck")).awaitTermination()
    assert sum(seen) == 5
    save_snapshot({"log": log}, str(tmp_path / "snap"))
    assert load_snapshot(spark, str(tmp_path / "snap"), ["log"])["log"].count() == 4
    assert live(log.withColumn("expire_at", F.when(F.col("seq") > 1, F.col("seq") * 10)), 30).count() == 2


@pytest.mark.parametrize("name", ["agg_groupby_reduce_all", "set_inter", "z_union_weights", "ft_term_bm25", "geo_radius", "x_claim_idle", "hybrid_rrf", "json_set_del"])
def test_queries_against_sql(spark, name):
    import os
    from collections import Counter

    import duckdb

    from keyframe import plans

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    want = c.sql(plans.ORACLES[name]).df()
    got = plans.QUERIES[name](spark, folder).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    count = lambda df: Counter(tuple(str(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))
    assert count(got) == count(want)
