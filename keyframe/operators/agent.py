"""Sessions, quotas, checkpoints and tool calls of agents."""

from __future__ import annotations

import uuid
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import within_time
from .leases import folded, opens_window


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 4)).cast("long")


def context_window(turns: DataFrame, budget: int, session: str = "session", turn: str = "turn", tokens: str = "tokens") -> DataFrame:
    """AGENT.MEM.CONTEXT: the newest turns of each session whose tokens together fit the budget."""
    newest = Window.partitionBy(session).orderBy(F.desc(turn)).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("used", F.sum(tokens).over(newest)).where(F.col("used") <= budget)


def recall(turns: DataFrame, recent: DataFrame, query: Column, k: int, session: str = "session", turn: str = "turn", vector: str = "embedding") -> DataFrame:
    """Turns outside the window that are nearest to the query, k of each session."""
    from ..functions.columns import cosine_distance

    rest = turns.join(recent.select(session, turn), [session, turn], "left_anti").withColumn("distance", cosine_distance(F.col(vector), query))
    place = F.row_number().over(Window.partitionBy(session).orderBy("distance", turn))
    return rest.withColumn("place", place).where(F.col("place") <= k)


def compact(turns: DataFrame, keep: int, summary: Column, session: str = "session", turn: str = "turn", tokens: str = "tokens") -> DataFrame:
    """AGENT.MEM.COMPACT: per session the turns compacted, those left (with the summary) and their tokens."""
    place = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(turn)))
    rows = turns.withColumn("_old", place > keep)
    sums = rows.groupBy(session).agg(F.count_if("_old").alias("compacted"), F.sum(F.when(F.col("_old"), 0).otherwise(F.col(tokens))).alias("_t"), F.count_if(~F.col("_old")).alias("_n"))
    some = (F.col("compacted") > 0).cast("long")
    return sums.select(session, "compacted", (F.col("_n") + some).alias("active"), (F.col("_t") + some * token_estimate(summary)).alias("active_tokens"))


def lineage(spark: SparkSession, steps: DataFrame, leaf: str, depth: int = 50) -> DataFrame:
    """AGENT.CHECKPOINT.HISTORY: from a step to its root: (step_id, parent_id, depth); stops at a step met before."""
    view = f"checkpoint_steps_{uuid.uuid4().hex}"
    steps.createOrReplaceTempView(view)
    return spark.sql(
        f"""WITH RECURSIVE walk(step_id, parent_id, depth, seen) AS (
             SELECT step_id, parent_id, 0, array(step_id) FROM {view} WHERE step_id = :leaf
             UNION ALL
             SELECT s.step_id, s.parent_id, w.depth + 1, array_append(w.seen, s.step_id)
             FROM {view} s JOIN walk w ON s.step_id = w.parent_id
             WHERE w.depth + 1 < :depth AND NOT array_contains(w.seen, s.step_id))
           SELECT step_id, parent_id, depth FROM walk""",
        args={"leaf": leaf, "depth": depth},
    )


def add_turns(turns: DataFrame, new: DataFrame, session: str = "session", turn: str = "turn") -> DataFrame:
    """AGENT.MEM.ADD: turns (session, turn, role, content, tokens) with those of new (session, seq, role, content, tokens), numbered
    on from each session's last; tokens that are null are estimated."""
    last = turns.groupBy(session).agg(F.max(turn).alias("_last"))
    place = F.row_number().over(Window.partitionBy(session).orderBy("seq"))
    rows = new.withColumn("_place", place).join(last, session, "left")
    rows = rows.select(session, (F.coalesce("_last", F.lit(0)) + F.col("_place")).cast("long").alias(turn), "role", "content", F.coalesce("tokens", token_estimate(F.col("content"))).alias("tokens"))
    return turns.unionByName(rows.select(*turns.columns))


def memory_info(turns: DataFrame, session: str = "session", turn: str = "turn", tokens: str = "tokens") -> DataFrame:
    """AGENT.MEM.INFO: turns, active turns (not `compacted`) and their tokens of each session."""
    active = ~F.col("compacted")
    return turns.groupBy(session).agg(F.count("*").alias("total_turns"), F.count_if(active).alias("active_turns"), F.sum(F.when(active, F.col(tokens)).otherwise(0)).alias("active_tokens"))


def clear_memory(turns: DataFrame, gone: DataFrame, session: str = "session") -> DataFrame:
    """AGENT.MEM.CLEAR."""
    return turns.join(gone.select(session), session, "left_anti")


def checkpoints(puts: DataFrame, thread: str = "thread", step: str = "step_id", order: str = "put_no") -> DataFrame:
    """AGENT.CHECKPOINT.PUT: the nodes after all puts: each step's last put, numbered (seq) in the order of puts, and whether it is the head."""
    place = F.row_number().over(Window.partitionBy(thread).orderBy(order))
    rest = [c for c in puts.columns if c not in (thread, step, order)]
    numbered = puts.withColumn("seq", place.cast("long"))
    last = numbered.groupBy(thread, step).agg(F.max_by(F.struct("seq", *rest), "seq").alias("_p")).select(thread, step, "_p.*")
    head = F.max("seq").over(Window.partitionBy(thread))
    return last.withColumn("head", F.col("seq") == head)


def checkpoint(nodes: DataFrame, request: DataFrame, thread: str = "thread", step: str = "step_id") -> DataFrame:
    """AGENT.CHECKPOINT.GET: the node of each requested (thread, step_id), of a null step the head."""
    asked = request.select(F.col(thread).alias("_thread"), F.col(step).alias("_step"))
    hit = (F.col(thread) == F.col("_thread")) & (F.when(F.col("_step").isNull(), F.col("head")).otherwise(F.col(step) == F.col("_step")))
    return nodes.join(asked, hit).drop("_thread", "_step")


def quota_pressure(calls: DataFrame, window_ms: int, key: str = "key", ts: str = "ts_ms", tokens: str = "tokens") -> DataFrame:
    """LLM.QUOTA: requests and tokens of each key in the window that ends with each call (what admission is decided on)."""
    rows = within_time(calls, [key], ts, window_ms, requests=F.count("*"), window_tokens=F.sum(tokens), _known=F.count(tokens))
    return rows.withColumn("window_tokens", F.when(F.col("_known") > 0, F.col("window_tokens"))).drop("_known")


def tool_claims(calls: DataFrame, lease_ms: int, key: str = "call_id", ts: str = "ts_ms", *ties: str) -> DataFrame:
    """AGENT.TOOL.CLAIM: whether each claim gets the lease: none was granted within lease_ms before. A refused claim doesn't extend a lease."""
    return opens_window(calls, [key], ts, lease_ms, "granted", *ties)


def tool_states(log: DataFrame, key: str = "call_id", ts: str = "ts_ms", *ties: str) -> DataFrame:
    """AGENT.TOOL.CLAIM and COMPLETE: rows of log (key, ts, op: claim or complete, ttl_ms: of a lease, or null, or how long a result stays)
    with state (claimed, in_progress or completed; null for a completion) and attempt."""

    def step(held: tuple | None, op: str, now: int, ttl: int | None) -> tuple[tuple | None, tuple]:
        done, lease, until, attempt = held or (False, None, None, 0)
        if held and until is not None and now >= until:
            done, lease, until, attempt = False, None, None, 0
        if op == "complete":
            return (True, None, None if ttl is None else now + max(1, ttl), max(1, attempt)), (None, None)
        if done:
            return (done, lease, until, attempt), ("completed", None)
        if lease is not None and now < lease:
            return (done, lease, until, attempt), ("in_progress", None)
        return (False, now + max(1, ttl or 1), None, attempt + 1), ("claimed", attempt + 1)

    out = [T.StructField("state", T.StringType()), T.StructField("attempt", T.LongType())]
    return folded(log, [key], [ts, *ties], ["op", ts, "ttl_ms"], step, out)


def quota_decisions(log: DataFrame, requests: int, tokens: int, window_ms: int, key: str = "key", ts: str = "ts_ms", *ties: str) -> DataFrame:
    """LLM.QUOTA.RESERVE and SETTLE: rows of log (key, ts, op: reserve or settle, call, tokens) with allowed and remaining tokens.
    A settle replaces the tokens of an allowed call that is still in the window. State: the calls of one window, at most `requests`."""

    def step(held: tuple | None, op: str, now: int, call, n: int) -> tuple[tuple, tuple]:
        calls = [c for c in held or () if c[0] > now - window_ms]
        if op == "settle":
            found = any(c[1] == call for c in calls)
            calls = [(t, c, n if c == call else k) for t, c, k in calls]
            return tuple(calls), (found, tokens - sum(c[2] for c in calls))
        used = sum(c[2] for c in calls)
        allowed = len(calls) < requests and used + n <= tokens
        if allowed:
            calls.append((now, call, n))
            used += n
        return tuple(calls), (allowed, tokens - used)

    out = [T.StructField("allowed", T.BooleanType()), T.StructField("remaining", T.LongType())]
    return folded(log, [key], [ts, *ties], ["op", ts, "call", "tokens"], step, out)
