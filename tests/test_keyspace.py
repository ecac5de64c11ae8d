"""Strings, lists, sets, sorted sets, bitmaps, hashes and keys on small stores."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from keyframe.functions.columns import byte_range, glob_to_regex, overwrite
from keyframe.operators import bitmaps, hashes, keyspace, lists, sets, strings, zsets


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_queries_read_whole_tables(spark, tmp_path):
    from keyframe import plans

    spark.range(1, 301).selectExpr("id AS p_partkey", "concat('green', id) AS p_name", "'ECONOMY green' AS p_type").write.parquet(str(tmp_path / "part.parquet"))
    assert plans.QUERIES["str_lcs"](spark, str(tmp_path)).count() == 300
    spark.range(250, 1001).selectExpr("id * 2 AS o_orderkey").union(spark.range(1, 500).selectExpr("id AS o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    got = plans.QUERIES["agent_checkpoint_history"](spark, str(tmp_path))
    assert sorted(r["depth"] for r in got.collect()) == list(range(9))


def test_bounded_increments(spark):
    log = spark.createDataFrame([("a", 1, 100), ("a", 2, 5), ("a", 3, -10), ("a", 4, 0)], "key string, seq long, delta long")
    assert rows(strings.bounded_increments(log)) == [("a", 95, 0)]
    high = spark.createDataFrame([("a", 1, 50), ("a", 2, 100)], "key string, seq long, delta long")
    assert rows(strings.bounded_increments(high, high=80)) == [("a", 80, 30)]
    assert rows(strings.bounded_increments(high, high=80, saturate=False)) == [("a", 50, 0)]


def test_string_ranges(spark):
    df = spark.createDataFrame([("This is a string",), ("",)], "v string")
    assert rows(df.select(byte_range(F.col("v"), 0, 3), byte_range(F.col("v"), -3, -1), byte_range(F.col("v"), 10, 100)))[0] == ("This", "ing", "string")
    assert rows(df.select(byte_range(F.col("v"), 0, 3)))[1] == ("",)
    assert rows(df.select(overwrite(F.col("v"), 5, "XX")))[0] == ("This XX a string",)


def test_lcs(spark):
    df = spark.createDataFrame([("ohmytext", "mynewtext"), (None, "a"), ("", "a")], "a string, b string")
    assert rows(df.select(strings.longest_common_subsequence("a", "b"))) == [("mytext",), (None,), ("",)]


def test_increment_overflow_is_null(spark):
    log = spark.createDataFrame([("a", 2**63 - 1), ("a", 1), ("b", 1)], "key string, delta long")
    assert rows(strings.increment(log), "key") == [("a", None), ("b", 1)]


@pytest.mark.parametrize(("pattern", "hit", "miss"), [("h?llo", "hello", "heello"), ("h*llo", "heeello", "hallo!"), ("h[ae]llo", "hallo", "hillo"), ("h[^e]llo", "hallo", "hello"), ("a\\*b", "a*b", "axb"), ("h[a-b]llo", "hbllo", "hcllo")])
def test_globs(spark, pattern, hit, miss):
    df = spark.createDataFrame([(hit,), (miss,)], "key string")
    assert rows(df.where(F.col("key").rlike(glob_to_regex(pattern)))) == [(hit,)]
    assert rows(keyspace.matching(df, pattern)) == [(hit,)]


ZSET = [("a", "a", 1.0), ("a", "b", 2.0), ("a", "c", 3.0), ("b", "b", 1.0), ("b", "c", 2.0), ("b", "d", 3.0)]


def test_weighted_unions(spark):
    z = spark.createDataFrame(ZSET, "key string, member string, score double")
    combine = lambda *a, **k: rows(zsets.combine(z, ["a", "b"], *a, **k), "score", "member")
    assert combine("union") == [("a", 1), ("b", 3), ("d", 3), ("c", 5)]
    assert combine("union", [2.0, 3.0]) == [("a", 2), ("b", 7), ("d", 9), ("c", 12)]
    assert combine("inter", [2.0, 3.0]) == [("b", 7), ("c", 12)]
    assert combine("union", aggregate="min") == [("a", 1), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(zsets.difference(z, ["a", "b"])) == [("a", 1.0)]


def test_ranks_and_pops(spark):
    z = spark.createDataFrame(ZSET, "key string, member string, score double")
    assert [r[1] for r in rows(zsets.by_rank(z.where("key = 'a'"), -2, -1), "rank")] == ["b", "c"]
    taken, rest = zsets.pop(z.where("key = 'a'"), 1, highest=True)
    assert [r[1] for r in rows(taken)] == ["c"] and rest.count() == 2
    grown = zsets.add(z.where("key = 'a'"), spark.createDataFrame([("a", "a", 5.0), ("a", "c", 1.0), ("a", "x", 9.0)], "key string, member string, score double"), "GT")
    assert rows(grown, "member") == [("a", "a", 5.0), ("a", "b", 2.0), ("a", "c", 3.0), ("a", "x", 9.0)]


def test_set_algebra(spark):
    s = spark.createDataFrame([(1, x) for x in range(10)] + [(2, x) for x in range(4, 14)] + [(2, 4)], "key int, member int")
    assert sorted(r[0] for r in rows(sets.intersect(s, [1, 2]))) == [4, 5, 6, 7, 8, 9]
    assert rows(sets.cardinality(sets.intersect(s, [1, 2]), 3)) == [(3,)]
    assert sorted(r[0] for r in rows(sets.difference(s, [1, 2]))) == [0, 1, 2, 3]
    assert len(rows(sets.sample(s, -15, 1))) == 30 and len(rows(sets.sample(s, 3, 1))) == 6
    assert rows(sets.sample(s, 3, 1), "key", "member") == rows(sets.sample(s, 3, 1), "key", "member")
    assert (2, 0) in rows(sets.move(s, 1, 2, 0)) and (1, 0) not in rows(sets.move(s, 1, 2, 0))


def test_lists(spark):
    one = spark.createDataFrame([("k", i, v) for i, v in enumerate("abcab")], "key string, pos long, value string")
    text = lambda df: "".join(r["value"] for r in df.orderBy("pos").collect())
    assert text(lists.range_of(one, 1, -2)) == "bca"
    assert text(lists.remove(one, "a", 1)) == "bcab" and text(lists.remove(one, "a", -1)) == "abcb" and text(lists.remove(one, "a")) == "bcb"
    assert [r[1] for r in rows(lists.positions(one, "a", count=0), "index")] == [0, 3]
    assert [r[1] for r in rows(lists.positions(one, "b", rank=-1))] == [4]
    assert text(lists.insert(one, "c", "x")) == "abxcab" and text(lists.insert(one, "c", "x", before=False)) == "abcxab"
    assert text(lists.push(one, spark.createDataFrame([("k", 1, "y"), ("k", 2, "z")], one.schema), left=True)) == "zyabcab"
    assert text(lists.set_at(one, -1, "!")) == "abca!"
    assert text(lists.move(one, "k", "other", from_left=False).where("key = 'other'")) == "b"


def test_bitmaps(spark):
    bits = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 0)], "key string, offset long")
    assert rows(bitmaps.first_bit(bits, 0), "key") == [("a", 0), ("b", 1)]
    assert rows(bitmaps.combine(bits, "and", keys=["a", "b"])) == [(2,)]
    assert sorted(rows(bitmaps.combine(bits, "xor", keys=["a", "b"]))) == [(0,), (1,)]
    df = spark.createDataFrame([(100, 100)], "v int, d int")
    assert rows(df.select(*(bitmaps.field_increment(F.col("v"), F.col("d"), 8, True, m) for m in ("wrap", "sat", "fail")))) == [(-56, 127, None)]


def test_hash_expiry(spark):
    h = spark.createDataFrame([("k", "a", 1, None), ("k", "b", 2, 500)], "key string, field string, value int, expire_at long")
    due = spark.createDataFrame([("k", "a", 900), ("k", "b", 900)], "key string, field string, at long")
    ask = spark.createDataFrame([("k", "a"), ("k", "b"), ("k", "z")], "key string, field string")
    assert rows(hashes.remaining(hashes.expire_fields(h, due, "XX"), ask, 100), "field") == [("k", "a", -1), ("k", "b", 800), ("k", "z", -2)]
    assert rows(hashes.remaining(hashes.expire_fields(h, due, "GT"), ask, 100), "field") == [("k", "a", -1), ("k", "b", 800), ("k", "z", -2)]
    assert rows(hashes.remaining(hashes.expire_fields(h, due, "NX"), ask, 600), "field") == [("k", "a", 300), ("k", "b", -2), ("k", "z", -2)]


def test_scan_pages_cover_all(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(50)], "key string")
    seen, cursor = [], -(1 << 63)
    for _ in range(20):
        page = keyspace.scan(keys, cursor, 7).collect()
        if not page:
            break
        seen += [r["key"] for r in page]
        cursor = max(r["slot"] for r in page)
    assert sorted(seen) == sorted(f"k{i}" for i in range(50))
