"""Language, toxicity and neighbours: held-out accuracy, recall, defined results."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keyframe.llm import language, neighbours, toxicity


@pytest.fixture(scope="module")
def labelled(spark, prose):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(5, 80), lang := rng.choice(["en", "de", "fr"])), lang) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language(labelled):
    got = language.identify_languages(labelled).join(labelled.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and (got["lang_pred"] == got["lang"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_language_ignores_the_label_of_scored_rows(labelled):
    other = labelled.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    key = lambda df: sorted(tuple(r) for r in language.identify_languages(df).collect())
    assert key(labelled) == key(other)


def test_language_odd(odd_docs, no_docs):
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify_languages(odd_docs).collect()}
    assert all(got[i] == "und" for i in (0, 1, 2, 3, 10)) and got[4] in ("en", "de")
    assert language.identify_languages(no_docs).count() == 0
    assert language.with_language(odd_docs).columns == odd_docs.columns
    unknown = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify_languages(unknown).collect()} == {"und"}


def test_codes_are_apart():
    for n in (2, 4, 6, 12, 40):
        code = language.codewords(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= (2 if n > 2 else 1)


BAD = ["moron", "scum", "idiotic", "lowlife"]


@pytest.fixture(scope="module")
def toxic(spark, prose):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(700):
        words = prose(rng, rng.randint(10, 60)).split(" ")
        bad = rng.random() < 0.3
        if bad:
            words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", ",", "!"])
        if rng.random() < (0.6 if bad else 0.02):  # group mentions go along with toxic texts here
            words[rng.randrange(len(words))] = "muslims"
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(toxic):
    docs, labels = toxic
    got = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["toxic"]).mean() > 0.95 and got["score"].between(0, 1).all()


def test_counterfactual_penalty_spares_neutral_mentions(spark, toxic):
    docs, labels = toxic
    rows = docs.join(labels.withColumnRenamed("toxic", "label"), "doc_id").select("text", "label")
    weight = lambda c: toxicity.fit_toxicity_model(rows, counterfactual=c).word_score("muslims")
    free, held = weight(0.0), weight(20.0)
    assert free > 0.5 and abs(held) < 0.3 * free


def test_toxicity_odd(odd_docs, no_docs, spark, toxic):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None), (7, 9)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(odd_docs, labels).count() == odd_docs.count()
    assert toxicity.score_toxicity(no_docs, labels).count() == 0
    assert {r["score"] < 0.3 for r in toxicity.score_toxicity(odd_docs, labels.limit(0)).collect()} == {True}


def brute_nearest(rows, queries, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        s = np.round(x @ x[i], 12)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [int(ids[j]) for j in order]
    return out


@pytest.mark.parametrize("kind", ["random", "clusters", "copies"])
def test_neighbours(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16))
    if kind == "clusters":
        x = rng.normal(size=(9, 16))[np.arange(900) % 9] * 4 + x
    if kind == "copies":
        x[:400] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    want = brute_nearest(rows, range(0, 900, 50))
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert abs(r["score"] - x[r["query_id"]] @ x[r["vec_id"]] / np.linalg.norm(x[r["query_id"]]) / np.linalg.norm(x[r["vec_id"]])) < 1e-9
    assert set(found) == set(want) and all(len(v) == 5 for v in found.values())
    assert np.mean([len(set(found[q]) & set(want[q])) / 5 for q in want]) >= 0.9
    if kind == "copies":
        assert found[0] == [1, 2, 3, 4, 5] and found[350] == [0, 1, 2, 3, 4]


def test_neighbours_odd(spark):
    bad = [(None, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, []), (6, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([*bad, (0, [1.0, 0.0]), (50, [2.0, 0.0]), (50, [2.0, 0.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest_neighbours(df, df.where("vec_id % 50 = 0")).collect()]
    assert sorted(got) == [(0, 1, 50), (0, 2, 7), (50, 1, 0), (50, 2, 7)]
    assert neighbours.nearest_neighbours(df.limit(0), df.limit(0)).count() == 0


def test_pipeline_keeps_rows_of_null_and_repeated_ids(spark, prose):
    rng = random.Random(4)
    own = [prose(rng, 60 + 5 * i) for i in range(8)]
    near = own[0].replace(" ", " odd ", 1)  # a near copy of the first null-id row
    rows = [(None, own[0]), (None, own[1]), (None, ""), (None, near), (4, own[2]), (4, own[3]), (5, own[4]), (6, own[5]), (6, own[5]), (7, f"{own[6]}\n{own[7]}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    key = lambda df: sorted((str(r["doc_id"]), r["text"]) for r in df.collect())
    want = sorted((str(i), t) for i, t in rows if t != near)
    want.remove(("6", own[5]))
    got = key(stages["near_dedup"](spark, docs, ""))
    assert got == want or got == sorted([x for x in want if x[1] != own[0]] + [("None", near)])
    lines_ = {(str(i), t) for i, t in rows if i != 6 and t not in (own[0], near)}
    assert lines_ <= set(key(stages["line_dedup"](spark, docs, "")))
    # a budget of 1.5 times all words: each row once whole, and again as far as it goes
    mixed = key(stages["mixing"](spark, docs, ""))
    whole = sum(len(t.split()) for _, t in rows)
    assert sum(len(t.split()) for _, t in mixed) == round(1.5 * whole)
    assert {(str(i), t) for i, t in rows if t} <= set(mixed)


def test_pipeline_stages(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            out.count()


def test_neighbours_of_proportional_vectors_go_to_smaller_ids(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    rows = [(i, (base * (1 + i % 13)).tolist()) for i in range(200)] + [(300 + i, rng.normal(size=8).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    score = lambda i: float(neighbours.cosines(np.array(rows[100][1]), np.array([rows[i][1]]))[0])
    want = sorted((i for i in range(200) if i != 100), key=lambda i: (-score(i), i))[:5]
    got = neighbours.nearest_neighbours(df, df.where("vec_id = 100")).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == want and [r["score"] for r in got] == [score(i) for i in want]
    huge = spark.createDataFrame([(0, [1e300, 1e300]), (50, [1e-300, 2e-300]), (1, [1e300, -1e300])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in neighbours.nearest_neighbours(huge, huge.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 50), (0, 1)]


def test_neighbours_deal_a_bin_s_queries_and_a_list_s_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BIN_QUERIES", 3)
    monkeypatch.setattr(neighbours, "BIN_ROWS", 40)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 6))
    rows = [(i * 10, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest_neighbours(df, df.where("vec_id % 50 = 0"), most_lists=4, search_ratio=100.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute_nearest(rows, range(0, 6000, 50))
    assert got == want


def test_walk_meets_the_nearest_centroids():
    rng = np.random.default_rng(1)
    sample = rng.normal(size=(3000, 12))
    graph = neighbours.build_graph(sample, 3000)
    x = neighbours.unit(rng.normal(size=(50, 12))).astype(np.float32)
    rows, nodes, dist = graph.within(x, 1.3)
    full = np.linalg.norm(x[:, None, :] - graph.centroids[None], axis=2)
    want = full <= full.min(1, keepdims=True) * 1.3
    assert want[rows, nodes].mean() > 0.95 and len(rows) > 0.95 * want.sum()
    load = np.bincount(neighbours.assign(graph, sample, 1, 1.1)[1], minlength=len(graph.centroids))
    assert load.max() < 5 * load.mean()
