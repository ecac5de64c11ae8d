"""Duplicate operators against brute force."""

from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyframe.llm import common, lines, neardup, substrings


def variants(prose, seed=3, n=60):
    """Texts, exact copies, near copies of several rates, shared passages and repeated lines."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(5, 250)) for _ in range(n)]
    passage = prose(rng, 70).replace("\n", " ")
    texts = list(base)
    for i in range(n):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"new{rng.randint(0, 999)}"
        texts.append(" ".join(words))
    texts += [base[0], base[0], base[1], f"{base[2]}\n{passage}", f"{passage} {base[3]}", base[4] + "\n" + base[5].split("\n")[0], "ab" * 400, "ab" * 300 + "c", passage]
    rng.shuffle(texts)
    return texts


@pytest.fixture(scope="module")
def copies(spark, prose):
    return spark.createDataFrame(list(enumerate(variants(prose))), "doc_id long, text string")


def brute_substrings(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        mark = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                mark[p : p + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~mark[:-1]])
        out[i] = (len(b), int(mark.sum()), int((mark[1:] < mark[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("slice_bytes", [1 << 18, 700])
def test_substrings(copies, slice_bytes, monkeypatch):
    import keyframe.llm.common as common

    monkeypatch.setattr(common.slices, "__defaults__", (slice_bytes,))
    want = brute_substrings([(r["doc_id"], r["text"]) for r in copies.collect()])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.without_repeated_substrings(copies.repartition(3)).collect()}
    assert got == want


def test_substrings_odd(spark, odd_docs, no_docs, odd_texts):
    assert substrings.without_repeated_substrings(no_docs).count() == 0
    got = substrings.without_repeated_substrings(odd_docs)
    assert got.count() >= odd_docs.count()
    one = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in got.collect()}
    assert one[8] == (300_000, 299_999) and one[1] == (0, 0)


def test_substrings_null_and_repeated_ids(spark, prose):
    rng = random.Random(5)
    passage, *own = (prose(rng, 80) for _ in range(9))
    rows = [(None, own[0]), (None, f"{own[1]} {passage}"), (3, f"{passage} {own[2]}"), (3, f"{own[3]} {passage}"), (3, own[4]), (3, own[4])]
    rows += [(5, own[0]), (5, own[5] + own[1]), (7, own[4]), (-2, own[6]), (8, own[7] + own[6])]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    found = brute_substrings([(i, text) for i, (_, text) in enumerate(ordered)])
    want = sorted((str(r[0]), *found[i]) for i, r in enumerate(ordered))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substrings.without_repeated_substrings(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def brute_lines(rows, t=0.8):
    sets = []
    for i, text in sorted(rows):
        for k, line in enumerate((text or "").split("\n")):
            if line.split():
                sets.append((i, k, frozenset(line.split())))
    distinct = list(dict.fromkeys(s for *_, s in sets))
    links = {s: {x for x in distinct if x != s and jaccard(s, x) >= t - 1e-12} for s in distinct}
    first = {}
    for i, k, s in sets:
        first.setdefault(s, (i, k))
    out = {i: [0, 0, i] for i, _ in rows}
    for i, k, s in sets:
        e = min([first[s], *(first[x] for x in links[s])])
        out[i] = [out[i][0] + len(links[s]), out[i][1] + ((i, k) > e), min(out[i][2], e[0])]
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize(("pairs", "threshold", "block"), [(4096, 0.8, 1 << 15), (3, 0.8, 3), (4096, 0.5, 1 << 15), (4096, 0.6, 7), (4096, 0.9, 1 << 15)])
def test_lines(copies, pairs, threshold, block, monkeypatch):
    monkeypatch.setattr(lines, "PAIRS", pairs)
    monkeypatch.setattr(lines, "BLOCK_ROWS", block)
    want = brute_lines([(r["doc_id"], r["text"]) for r in copies.collect()], threshold)
    got = {r["doc_id"]: (r["n_links"], r["n_removed"], r["class_id"]) for r in lines.line_duplicates(copies.repartition(3), threshold=threshold).collect()}
    assert got == want and sum(v[0] for v in want.values()) > 10


def test_least_size():
    assert [lines.least_size(t) for t in (0.5, 0.6, 0.75, 0.8, 0.9)] == [1, 2, 3, 4, 9]


def test_variants_of_a_template_line(spark, monkeypatch):
    """A line of many variants: its words are listed by all of them, and every pair matches."""
    monkeypatch.setattr(lines, "BLOCK_ROWS", 16)
    rows = [(i, f"w{i} this is a notice that many pages hold with a number in front number") for i in range(90)] + [(200, "aa bb cc"), (201, "aa bb dd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_links"], r["n_removed"], r["class_id"]) for r in lines.line_duplicates(docs).collect()}
    assert got == brute_lines(rows) and got[5][0] == 89
    assert {r["doc_id"]: r["n_links"] for r in lines.line_duplicates(docs, threshold=0.5).collect()}[201] == 1


def test_listings_are_shuffled_as_lists(spark, copies, monkeypatch):
    """A task sends a row for each bucket of words, not one for each word of a line; no listing is lost, and each set is once under a word."""
    monkeypatch.setattr(lines, "HELD", 50)
    sets = lines.line_sets(copies.unionAll(copies.selectExpr("doc_id + 1000", "text")).coalesce(1).repartition(2, "doc_id"), "doc_id", "text").cache()
    classes = spark.sparkContext.broadcast(lines.word_classes(sets))
    hot = spark.sparkContext.broadcast(lines.hot_words(sets, classes, 0.8))
    stored = [(r["set_key"], r["n"], np.frombuffer(r["tokens"], np.uint32)) for r in lines.listed_sets(sets, 0.8).collect()]
    want = []
    for key, n, tokens in stored:
        ordered = sorted(tokens.tolist(), key=lambda t: (classes.value[t & (lines.BUCKETS - 1)], t))
        want += [(t, n << 32 | i, key) for i, t in enumerate(ordered[: int(lines.prefix_lengths(np.array([n]), 0.8)[0])])]
    for buckets in (1, 8):
        rows = lines.prefix_lists(sets, classes, hot, buckets, 0.8).collect()
        got = [np.concatenate([np.frombuffer(r[c], kind) for r in rows]).tolist() for c, kind in lines.LISTING.items()]
        tokens = np.array(got[0], np.int32).view(np.uint32).tolist()
        assert sorted(zip(tokens, got[2], got[3], strict=True)) == sorted(want) and len(rows) < len(want) / 3
        assert all(len({r["bucket"] for r in rows if t in np.frombuffer(r["token"], np.int32)}) == 1 for t in got[0][:50])
        found = [tuple(r) for r in lines.listings_with_pairs(lines.prefix_lists(sets, classes, hot, buckets, 0.8), hot, 0.8).collect()]
        assert found and len(found) == len(set(found))
    sets.unpersist()


def test_removed_lines(copies):
    gone = {r["doc_id"]: r["removed_lines"] for r in lines.line_duplicates(copies).collect()}
    for r, new in zip(copies.orderBy("doc_id").collect(), lines.without_duplicate_lines(copies).orderBy("doc_id").collect(), strict=True):
        assert new["text"] == "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in gone[r["doc_id"]])


def test_lines_odd(odd_docs, no_docs):
    assert lines.line_duplicates(no_docs).count() == 0
    out = lines.without_duplicate_lines(odd_docs, length_col="n_chars")
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert out.where("doc_id = 0 AND text IS NULL").count() == 1


def shingle_counts(text):
    w = text.split()
    from collections import Counter

    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_jp(x, y):
    keys = set(x) | set(y)
    return sum(1 / sum(max(x[i] / x[d], y[i] / y[d]) for i in keys) for d in set(x) & set(y))


def brute_classes(rows):
    sets = [(i, shingle_counts(t or ""), t or "") for i, t in rows]
    parent = {i: i for i, *_ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, x, t) in enumerate(sets):
        for j, y, u in sets[:n]:
            if t == u or (set(x) & set(y) and brute_jp(x, y) >= 0.8):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("block", [4096, 3])
def test_near_duplicates(copies, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    want = brute_classes([(r["doc_id"], r["text"]) for r in copies.collect()])
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicate_classes(copies.repartition(3)).collect()}
    assert got == want and len(set(want.values())) < len(want) - 10
    kept = neardup.representatives(copies, neardup.near_duplicate_classes(copies))
    assert {r["doc_id"] for r in kept.collect()} == set(want.values())


def test_near_duplicates_odd(odd_docs, no_docs, odd_texts):
    assert neardup.near_duplicate_classes(no_docs).count() == 0
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicate_classes(odd_docs).collect()}
    assert got[None] is None and got[0] == got[1] == 0 and got[2] == got[13] == 2 and got[9] == 9


def test_near_duplicates_of_null_and_repeated_ids(spark, prose):
    rng = random.Random(6)
    a, b, c, d = (prose(rng, 120) for _ in range(4))
    near = lambda t: t + " more"
    rows = [(5, a), (5, b), (7, near(b)), (8, near(a)), (None, c), (9, near(c)), (None, d), (None, near(d)), (5, d + " x"), (2, "one two")]
    got = neardup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["class_id"] or -1, r["n_links"] > 0) for r in got))
    assert found == sorted([(False, 5, 5, True), (False, 5, 5, True), (False, 7, 5, True), (False, 8, 5, True), (True, 0, 9, True), (False, 9, 9, True), (True, 0, 5, True), (True, 0, 5, True), (False, 5, 5, True), (False, 2, 2, False)])


def test_pairs_of_a_torn_bucket_are_all_met(spark, monkeypatch):
    """Texts of one template that are too unlike to link: every pair whose estimate is near is proposed once, whatever the block."""
    rng = np.random.default_rng(7)
    n = 40
    h = [np.concatenate([np.arange(1, 401), rng.integers(1 << 20, 1 << 40, 60)]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(n)]
    row = np.repeat(np.arange(n), 460)
    kept = neardup.prob_min_hash(np.concatenate(h), row, np.ones(len(row)), n, neardup.SLOTS)
    low = (kept & np.uint64(15)).astype(np.uint8)
    packed = (low[:, ::2] | low[:, 1::2] << 4).view(np.int64)
    bands = np.arange(neardup.BANDS)[None, :] + 100 * (np.arange(n)[:, None] % 3 + np.arange(neardup.BANDS)[None, :] % 2)
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if (bands[i] == bands[j]).any() and neardup.unequal_slots(packed[[i]], packed[[j]])[0] <= neardup.MOST_UNEQUAL}
    rows = [(int(b), blocks, i, -1, i, bands[i].tolist(), packed[i].tolist()) for blocks in (5,) for i in range(n) for b in bands[i]]
    schema = "bucket long, blocks int, uid long, lead long, label long, bands array<long>, signature array<long>"
    for blocks in (1, 5):
        monkeypatch.setattr(neardup, "PAIRS", 7)
        df = spark.createDataFrame([(b, blocks, *rest) for b, _, *rest in rows], schema)
        got = [(r["a"], r["b"]) for r in neardup.pairs_in_buckets(df).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_probability_jaccard():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x = {int(k): int(rng.integers(1, 5)) for k in rng.choice(40, rng.integers(1, 30), replace=False)}
        y = {int(k): int(rng.integers(1, 5)) for k in rng.choice(40, rng.integers(1, 30), replace=False)}
        full = [{k: d.get(k, 0) for k in range(40)} for d in (x, y)]
        want = sum(1 / sum(max(full[0][i] / x[d], full[1][i] / y[d]) for i in range(40)) for d in set(x) & set(y))
        arrays = [(np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)], np.uint32)) for d in (x, y)]
        assert abs(neardup.probability_jaccard(*arrays[0], *arrays[1]) - want) < 1e-12


def test_signature_estimates_similarity():
    h = np.arange(1, 301, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = h[:250], h[50:]
    one = lambda x: neardup.prob_min_hash(x, np.zeros(len(x), np.int64), np.ones(len(x)), 1, 4096)[0]
    assert abs((one(a) == one(b)).mean() - 200 / 300) < 0.03


def test_short_texts_draw_many_arrivals_at_once(monkeypatch):
    """Slots keep what one arrival after the other gives, and a text of one shingle costs tens of draws in numpy, not thousands."""
    rng = np.random.default_rng(3)
    sizes, slots = [1, 2, 0, 30, 700, 5000], 512
    row = np.repeat(np.arange(len(sizes)), sizes)
    h, weight = rng.integers(1, 1 << 62, len(row)).astype(np.uint64), rng.integers(1, 4, len(row))
    want = np.zeros((len(sizes), slots), np.uint64)
    for r in set(row):
        early, own, time, step = np.full(slots, np.inf), h[row == r], 0.0, 0
        while (time <= early.max()).any():
            step += 1
            draw = neardup.mix64(own ^ neardup.mix64(np.array([step], np.uint64)))
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weight[row == r]
            for place, at, x in zip((neardup.mix64(draw) % np.uint64(slots)).tolist(), time, own, strict=True):
                if at < early[place]:
                    early[place], want[r, place] = at, x
    calls, mix64 = [], neardup.mix64
    monkeypatch.setattr(neardup, "mix64", lambda x: calls.append(1) or mix64(x))
    for arrivals in (1 << 14, 50):
        monkeypatch.setattr(neardup, "ARRIVALS", arrivals)
        assert (neardup.prob_min_hash(h, row, weight, len(sizes), slots) == want).all()
        assert arrivals < 1 << 14 or len(calls) < 300


def test_labels_of_few_edges_stand_in_few_files(spark):
    """A small graph's labels aren't written in a file for each shuffle partition."""
    edges = [(i, i + 1) for i in range(1, 400) if i % 10]
    with common.settings(spark, spark__sql__shuffle__partitions="60", spark__sql__adaptive__coalescePartitions__enabled="false"):
        labels, path = neardup.components(spark.createDataFrame(edges, "a long, b long"))
        assert {r["node"]: r["label"] for r in labels.collect()} == {i: (i - 1) // 10 * 10 + 1 for i in range(1, 401)}
    assert 0 < len([f for f in os.listdir(path.removeprefix("file:").replace("//", "/")) if f.endswith(".parquet")]) <= neardup.LEAST_FILES


def test_batches_of_long_texts_are_small(spark):
    """Python gets some megabytes of text at a time, however many rows that are."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    texts = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 3000).alias("text"))
    found, _ = common.materialize(texts.mapInArrow(sizes, "n long"), "batch-sizes")
    n = [r["n"] for r in found.collect()]
    assert sum(n) >= 18_000_000 and max(n) <= 2 * common.BATCH_BYTES
