"""Stateful streams, fed file by file."""

from __future__ import annotations

import random
import uuid

from pyspark.sql import functions as F

from keyframe.streaming import processors


def run(spark, tmp_path, batches, schema, build):
    """Rows of build(stream) after each batch went in as a file of its own."""
    name = f"out_{uuid.uuid4().hex}"
    source = tmp_path / name
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(source / f"b={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in spark.table(name).collect()]


def test_quota(spark, tmp_path):
    calls = [[("k", 1, 0, "reserve", 700)], [("k", 2, 1, "reserve", 500)], [("k", 1, 2, "settle", 400)], [("k", 3, 3, "reserve", 500)], [("k", 4, 70_000, "reserve", 900)]]
    got = run(spark, tmp_path, calls, "key string, call_id long, ts_ms long, op string, tokens long", lambda s: processors.quota(s, 2, 1000, 60_000))
    assert sorted(got) == [("k", 1, True, 300), ("k", 2, False, 300), ("k", 3, True, 100), ("k", 4, True, 100)]


def test_consumer_group(spark, tmp_path):
    b = [[("s", "entry", 1, "a"), ("s", "entry", 2, "b")], [("s", "ack", 1, ""), ("s", "entry", 2, "b"), ("s", "entry", 3, "c")]]
    got = run(spark, tmp_path, b, "key string, kind string, id long, payload string", lambda s: processors.consumer_group(s, 2))
    assert sorted(got) == [("s", 1, 0), ("s", 2, 1), ("s", 3, 0)]


def test_blocking_pop(spark, tmp_path):
    b = [[("q", "pop", 1, "c1"), ("q", "pop", 2, "c2")], [("q", "push", 3, "x")], [("q", "push", 4, "y"), ("q", "push", 5, "z")], [("q", "pop", 6, "c3")]]
    got = run(spark, tmp_path, b, "key string, kind string, seq long, value string", processors.blocking_pop)
    assert sorted(got) == [("q", "c1", "x"), ("q", "c2", "y"), ("q", "c3", "z")]


def test_tool_leases(spark, tmp_path):
    b = [[(1, 1, 0), (1, 2, 50)], [(1, 3, 99), (1, 4, 100)]]
    got = run(spark, tmp_path, b, "call_id long, claim_id long, ts_ms long", lambda s: processors.tool_leases(s, 100))
    assert sorted(got) == [(1, 1, True), (1, 2, False), (1, 3, False), (1, 4, True)]


def test_increasing(spark, tmp_path):
    b = [[("s", 5, 0), ("s", 4, 0)], [("s", 5, 0), ("s", 6, 0)]]
    got = run(spark, tmp_path, b, "key string, ms long, seq long", lambda s: processors.increasing(s, "key", "ms", "seq"))
    assert sorted(got) == [("s", 5, 0), ("s", 6, 0)]


WAITS = "group string, seq long, kind string, key string, value string, score double, client string, keys array<string>, count int, target string"


def test_blocking_store(spark, tmp_path):
    """Clients of several keys, moves that feed other clients, counts, and sorted sets; across batches."""
    push = lambda n, key, value, kind="rpush", score=None: ("g", n, kind, key, value, score, None, None, None, None)
    wait = lambda n, client, kind, keys, count=1, target=None: ("g", n, kind, None, None, None, client, keys, count, target)
    b = [
        [wait(1, "c1", "left", ["a", "b"]), wait(2, "c2", "left", ["b"])],
        [push(3, "b", "x")],  # c1 waits longest
        [push(4, "b", "y"), wait(5, "mover", "right", ["src"], 2, "<dst"), wait(6, "c3", "left", ["dst"])],
        [push(7, "src", "p")],  # goes to dst, and from there to c3
        [push(8, "z", "m1", "zadd", 5.0), push(9, "z", "m2", "zadd", 1.0), wait(10, "low", "min", ["none", "z"]), wait(11, "high", "max", ["z"], 3)],
        [push(12, "q", "1"), push(13, "q", "0", "lpush"), push(14, "q", "2"), wait(15, "many", "left", ["q"], 2)],
    ]
    got = sorted(run(spark, tmp_path, b, WAITS, processors.blocking_store), key=lambda r: (r[1], r[5]))
    assert got == [
        ("g", "c1", "b", "x", None, 0), ("g", "c2", "b", "y", None, 0), ("g", "c3", "dst", "p", None, 0), ("g", "high", "z", "m1", 5.0, 0),
        ("g", "low", "z", "m2", 1.0, 0), ("g", "many", "q", "0", None, 0), ("g", "many", "q", "1", None, 1), ("g", "mover", "src", "p", None, 0),
    ]


def test_increasing_in_order_of_a_column(spark):
    """Rows of a micro-batch come in any order; tops go from batch to batch, also of keys that a batch lacks."""
    rng = random.Random(6)
    data = [(rng.choice(["a", "b", None]), i + rng.randrange(30), i) for i in range(400)] + [("c", 5, 0)]
    want, top = [], {}
    for k, ms, seq in sorted(data, key=lambda r: r[2]):
        if (ms, seq) > top.get(k, (-1, -1)):
            top[k] = (ms, seq)
            want.append((k, ms, seq))
    for cuts in ((0, 500), (0, 150, 151, 500)):
        got, tops = [], None
        for low, high in zip(cuts, cuts[1:], strict=False):
            rows = [r for r in data if low <= r[2] < high]
            rng.shuffle(rows)
            kept, tops = processors.above_all_before(spark.createDataFrame(rows, "key string, ms long, seq long").repartition(4), tops, "key", "ms", "seq", "seq", 16)
            got += [tuple(r) for r in kept.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_increasing_query_of_many_splits(spark, tmp_path):
    """The query over a table whose rows lie out of order and in several row groups."""
    from keyframe.plans import QUERIES

    rows = [(i, (i * 7919) % 1000 * 1_000_000, "ab"[i % 2]) for i in range(1000)]
    random.Random(7).shuffle(rows)
    df = spark.createDataFrame(rows, "event_id long, us long, event_type string").select("event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "event_type")
    df.coalesce(1).write.parquet(str(tmp_path / "w"))
    next((tmp_path / "w").glob("*.parquet")).rename(tmp_path / "events.parquet")
    want, top = {}, {}
    for i, us, k in sorted(rows):
        if us >= top.get(k, -1):
            want[k] = want.get(k, 0) + 1
        top[k] = max(us, top.get(k, -1))
    assert {r["key"]: r["n"] for r in QUERIES["stream_increasing_ids"](spark, f"file://{tmp_path}").collect()} == want
