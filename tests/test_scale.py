"""Steps that must not grow faster than their tables, held against plain forms."""

from __future__ import annotations

import math
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from keyframe.functions.columns import DISTANCES
from keyframe.functions.text import index_terms
from keyframe.operators import agent, search, vectors


def test_nearest_in_tiles(spark, monkeypatch):
    """Copies, multiples, zero, missing and cut vectors, and numbers that aren't finite: ranks as by the plain expression, no distance last."""
    rng = random.Random(5)
    some = [[rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0, 1.1]) for _ in range(6)] for _ in range(60)]
    odd = [None, [0.0] * 6, [-0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], [float("nan")] * 6, [float("inf")] + [1.0] * 5, [1e30] * 6]
    data = list(enumerate(some + odd + some[:20] + [some[0]] * 40 + [[2 * x for x in v] for v in some[20:30]]))
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    asked = df.where("vec_id % 2 = 0")
    monkeypatch.setattr(vectors, "TILE_ROWS", 50)
    monkeypatch.setattr(vectors, "TILE_QUERIES", 30)
    monkeypatch.setattr(vectors, "STRIP", 128)
    pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q")).crossJoin(df).where("vec_id <> query_id").cache()
    for metric in ("l2", "ip", "cosine"):
        order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "vec_id")
        want = pairs.withColumn("distance", DISTANCES[metric](F.col("embedding"), F.col("_q"))).withColumn("rank", F.row_number().over(order)).where("rank <= 7")
        got = vectors.nearest_per_query(df, asked, 7, metric)
        rows = [sorted((r["query_id"], r["rank"], r["vec_id"], repr(r["distance"])) for r in x.collect()) for x in (want, got)]
        assert rows[0] == rows[1], metric


def test_tiles_instead_of_a_scan_per_block_of_queries(spark):
    df = spark.range(600).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2)).alias("embedding"))
    plan = vectors.nearest_per_query(df, df, 2)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and plan.count("Range (") == 2


def test_time_windows_cost_the_same_however_dense(spark):
    """Nulls in the time, the key and the tokens, equal times, gaps over blocks; and no frame that is summed anew for each row."""
    rng = random.Random(8)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(-40, 400), rng.randrange(40)]), rng.choice([None, rng.randrange(9)]), i) for i in range(500)] + [("c", 0, None, 900), ("c", 99, 4, 901), ("c", 100, None, 902), ("c", 124, 1, 903)]
    df = spark.createDataFrame(data, "key string, ts_ms long, tokens long, i long").repartition(4)
    span = Window.partitionBy("key").orderBy("ts_ms").rangeBetween(-24, 0)
    want = {r["i"]: (r["n"], r["s"]) for r in df.withColumn("n", F.count("*").over(span)).withColumn("s", F.sum("tokens").over(span)).collect()}
    got = agent.quota_pressure(df, 25)
    assert {r["i"]: (r["requests"], r["window_tokens"]) for r in got.collect()} == want
    assert "RangeFrame, -" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_index_counts_where_texts_are_read(spark, tmp_path, monkeypatch):
    """Slices smaller than a text, texts without words and null ones, words of one stem; and one shuffle, with no table of counts beside it."""
    monkeypatch.setattr(search, "SLICE_WORDS", 5)
    monkeypatch.setattr(search, "TEXT_ROWS", 2)
    data = [(i, None if i % 7 == 3 else " ".join(random.Random(i).choices(["run", "runs", "running", "licenses", "license", "the", "x2", "Bees"], k=i % 11))) for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id int, t string").repartition(3)
    own = search.Index.create(docs, "doc_id", "t", f"file://{tmp_path}/i")
    terms = index_terms(docs, "doc_id", "t").cache()
    assert [tuple(r) for r in own.info().collect()] == [(60, terms.select("term").distinct().count(), terms.count())]
    tf = {(r["term"], r["doc_id"]): r["n"] for r in terms.groupBy("term", "doc_id").agg(F.count("*").alias("n")).collect()}
    length = {i: sum(n for (_, j), n in tf.items() if i == j) for i, _ in data}
    assert {r["doc_id"]: r["doc_len"] for r in own.docs.collect()} == length
    mean = sum(length.values()) / 60
    for word, term in (("license", "license"), ("runs", "run"), ("running", "runn")):
        ids = {i: n for (t, i), n in tf.items() if t == term}
        idf = max(0.0001, math.log(1 + (60 - len(ids) + 0.5) / (len(ids) + 0.5)))
        want = {i: round(idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length[i] / mean)), 9) for i, n in ids.items()}
        assert {r["doc_id"]: round(r["score"], 9) for r in own.term(word).collect()} == want, word
    assert [p.name for p in (tmp_path / "i").iterdir()] == ["postings"]
