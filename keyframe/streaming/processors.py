"""Stateful streams: consumer groups, blocking pops, quotas, leases and deduplication.

Each processor is a Structured Streaming query over keyed state, so it recovers from its
checkpoint. State is bounded per key by what the operator itself must remember (pending
entries, waiting clients, the calls of one window) and expires by timers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.blocks import before


def deduplicated(stream: DataFrame, keys: list[str], time_col: str, window: str) -> DataFrame:
    """XADD IDMP: the first of the rows that agree in keys within a time window; state is dropped by the watermark."""
    return stream.withWatermark(time_col, window).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time_col: str, size: str, late: str, *keys: str) -> DataFrame:
    """Rows per key and tumbling window; rows later than the watermark are left out."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, size), *keys).agg(F.count("*").alias("n"))


def increasing(stream: DataFrame, key: str, ms: str, seq: str) -> DataFrame:
    """XADD with own ids: entries whose id is above all before of their key; the others are rejected. Entries of a key must come in
    the order of arrival, one file or topic partition each; where a column tells it, above_all_before() takes them in that order."""

    def step(key_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = state.get if state.exists else (-1, -1)
        for rows in batches:
            kept = []
            for i, x in zip(rows.index, rows[[ms, seq]].itertuples(index=False, name=None), strict=True):
                if x > top:
                    top = x
                    kept.append(i)
            yield rows.loc[kept]
        state.update(tuple(int(v) for v in top))

    return stream.groupBy(key).applyInPandasWithState(step, stream.schema, "ms long, seq long", "append", GroupStateTimeout.NoTimeout)


def above_all_before(batch: DataFrame, tops: DataFrame | None, key: str, ms: str, seq: str, order: str, size: int = 65_536) -> tuple[DataFrame, DataFrame]:
    """increasing() for a micro-batch whose rows arrived in the order of a column, as reading and shuffling don't keep that order: the
    entries taken in, and the top id of each key after them, to be handed to the next batch. A key's rows are cut into blocks of `order`."""
    names = batch.columns
    rows = before(batch, [key], order, size, "_top", F.struct(ms, seq), F.max)
    own = batch.groupBy(key).agg(F.max(F.struct(ms, seq)).alias("top"))
    if tops is None:
        return rows.where(F.col("_top").isNull() | (F.struct(ms, seq) > F.col("_top"))).select(*names), own
    held = tops.select(F.col(key).alias("_key"), F.col("top").alias("_held"))
    rows = rows.join(held, F.col(key).eqNullSafe(F.col("_key")), "left")
    top = F.greatest("_top", "_held")
    after = tops.unionByName(own).groupBy(key).agg(F.max("top").alias("top"))
    return rows.where(top.isNull() | (F.struct(ms, seq) > top)).select(*names), after


class Quota(StatefulProcessor):
    """LLM.QUOTA.RESERVE: a call is allowed if the window behind it has room for one more request and its tokens.

    Rows: key, call_id, ts_ms, op (reserve or settle), tokens. A settle replaces the tokens
    of an allowed call by the actual number. Refused calls don't count.
    """

    def __init__(self, requests: int, tokens: int, window_ms: int) -> None:
        self.requests, self.tokens, self.window_ms = requests, tokens, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.calls = handle.getMapState("calls", "call_id long", "ts_ms long, tokens long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = {k[0]: (v[0], v[1]) for k, v in self.calls.iterator()}
        before = set(held)
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts_ms", "call_id"], kind="stable").itertuples():
            held = {k: v for k, v in held.items() if v[0] > r.ts_ms - self.window_ms}
            used = sum(v[1] for v in held.values())
            if r.op == "settle":
                if r.call_id in held:
                    held[r.call_id] = (held[r.call_id][0], int(r.tokens))
                continue
            allowed = len(held) < self.requests and used + r.tokens <= self.tokens
            if allowed:
                held[r.call_id] = (int(r.ts_ms), int(r.tokens))
                used += int(r.tokens)
            out.append((key[0], r.call_id, allowed, self.tokens - used))
        for k in before - set(held):
            self.calls.removeKey((k,))
        for k, v in held.items():
            self.calls.updateValue((int(k),), (int(v[0]), int(v[1])))
        yield pd.DataFrame(out, columns=["key", "call_id", "allowed", "remaining"])

    def close(self) -> None:
        pass


def quota(stream: DataFrame, requests: int, tokens: int, window_ms: int) -> DataFrame:
    return stream.groupBy("key").transformWithStateInPandas(Quota(requests, tokens, window_ms), "key string, call_id long, allowed boolean, remaining long", "Append", "None")


class Group(StatefulProcessor):
    """Consumer group: entries go to consumers in turn and stay pending until acknowledged.

    Rows: key, kind (entry or ack), id, payload. Emits deliveries (key, id, consumer) for
    entries above the last delivered id; an ack drops the pending entry.
    """

    def __init__(self, consumers: int) -> None:
        self.consumers = consumers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getMapState("pending", "id long", "consumer int")
        self.last = handle.getValueState("last", "id long, turn int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, turn = self.last.get() if self.last.exists() else (-1, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values(["id", "kind"], ascending=[True, False]).itertuples():
            if r.kind == "ack":
                if self.pending.containsKey((int(r.id),)):
                    self.pending.removeKey((int(r.id),))
            elif r.id > last:
                self.pending.updateValue((int(r.id),), (turn,))
                out.append((key[0], int(r.id), turn))
                last, turn = int(r.id), (turn + 1) % self.consumers
        self.last.update((last, turn))
        yield pd.DataFrame(out, columns=["key", "id", "consumer"])

    def close(self) -> None:
        pass


def consumer_group(stream: DataFrame, consumers: int) -> DataFrame:
    return stream.groupBy("key").transformWithStateInPandas(Group(consumers), "key string, id long, consumer int", "Append", "None")


class BlockingPop(StatefulProcessor):
    """BLPOP and BRPOP: clients wait for elements, oldest client first; elements wait for clients.

    Rows: key, kind (push or pop), seq, value (the element, or the client's name).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "value string")
        self.clients = handle.getListState("clients", "value string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        items, clients = [x[0] for x in self.items.get()], [x[0] for x in self.clients.get()]
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            (items if r.kind == "push" else clients).append(r.value)
            if items and clients:
                out.append((key[0], clients.pop(0), items.pop(0)))
        for state, values in ((self.items, items), (self.clients, clients)):
            state.clear()
            if values:
                state.put([(v,) for v in values])
        yield pd.DataFrame(out, columns=["key", "client", "value"])

    def close(self) -> None:
        pass


def blocking_pop(stream: DataFrame) -> DataFrame:
    return stream.groupBy("key").transformWithStateInPandas(BlockingPop(), "key string, client string, value string", "Append", "None")


def tool_leases(stream: DataFrame, lease_ms: int) -> DataFrame:
    """AGENT.TOOL.CLAIM: (call_id, claim_id, granted): a claim gets the lease if none holds it at its time; a refused claim changes nothing."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else -1
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts_ms", "claim_id"]).itertuples():
            granted = r.ts_ms >= until
            if granted:
                until = int(r.ts_ms) + lease_ms
            out.append((key[0], r.claim_id, granted))
        state.update((until,))
        yield pd.DataFrame(out, columns=["call_id", "claim_id", "granted"])

    return stream.groupBy("call_id").applyInPandasWithState(step, "call_id long, claim_id long, granted boolean", "until long", "append", GroupStateTimeout.NoTimeout)


class BlockingStore(StatefulProcessor):
    """BLPOP, BRPOP, BLMPOP, BLMOVE, BLMOVEM, BRPOPLPUSH, BZPOPMIN, BZPOPMAX, BZMPOP: clients that wait for the first of several keys to
    have elements, the longest waiting first.

    Rows: group (keys that clients may wait for together share one), seq, kind, key, value, score, client, keys, count, target.
    kind: rpush or lpush (value under key), zadd (value with score), or a wait: left, right (lists), min, max (sorted sets). A wait with
    a target moves what it gets to that list: to its right end, or to its left if target begins with '<'. Emits (group, client, key,
    value, score, place). State: what the group holds, and its waiting clients.
    """

    ITEM, CLIENT = "key string, value string, score double", "client string, kind string, keys array<string>, count int, target string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", self.ITEM)
        self.clients = handle.getListState("clients", self.CLIENT)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[str, float | None]]] = {}
        for k, value, score in self.items.get():
            held.setdefault(k, []).append((value, score))
        waiting = [tuple(c) for c in self.clients.get()]
        out: list[tuple] = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            if r.kind == "zadd":
                held[r.key] = [*(x for x in held.get(r.key, []) if x[0] != r.value), (r.value, float(r.score))]
            elif r.kind in ("rpush", "lpush"):
                held.setdefault(r.key, []).insert(0 if r.kind == "lpush" else len(held[r.key]), (r.value, None))
            else:
                waiting.append((r.client, r.kind, list(r.keys), int(r.count), r.target))
            served = True
            while served:  # a move may feed another client
                served = False
                for c in waiting:
                    if found := next((k for k in c[2] if held.get(k)), None):
                        out += [(key[0], c[0], found, *x, i) for i, x in enumerate(self.serve(held, found, c))]
                        waiting.remove(c)
                        served = True
                        break
        for state, values in ((self.items, [(k, *x) for k, v in held.items() for x in v]), (self.clients, waiting)):
            state.clear()
            if values:
                state.put(values)
        yield pd.DataFrame(out, columns=["group", "client", "key", "value", "score", "place"])

    @staticmethod
    def serve(held: dict, key: str, client: tuple) -> list[tuple]:
        _, kind, _, count, target = client
        if kind in ("min", "max"):
            held[key].sort(key=lambda x: (x[1], x[0]))
        got = [held[key].pop(0 if kind in ("left", "min") else -1) for _ in range(min(count, len(held[key])))]
        if target:
            to_left, name = target.startswith("<"), target.lstrip("<")
            for x in got:
                held.setdefault(name, []).insert(0 if to_left else len(held[name]), x)
        return got

    def close(self) -> None:
        pass


def blocking_store(stream: DataFrame) -> DataFrame:
    return stream.groupBy("group").transformWithStateInPandas(BlockingStore(), "group string, client string, key string, value string, score double, place int", "Append", "None")
