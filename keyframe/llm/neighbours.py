"""Approximate nearest neighbours: balanced posting lists.

A bounded sample is split again and again in two until its leaves are small; their means,
refined by a few rounds of k-means in which full leaves attract less, are the centroids,
of about equal load. A graph joins each centroid to its nearest ones; all searches for
centroids walk that graph in memory. Every vector is put in the posting list of its
nearest centroid, and a boundary vector also in those of centroids nearly as near (unless
a chosen centroid is nearer to that one than the vector is). A query walks the graph for
the centroids within a ratio of its least distance and scans their lists. The ratio is
that which finds `RECALL` of the neighbours that some rows of the sample have in it (these
are farther apart than all rows' neighbours, so the ratio rather errs upwards).

Equal vectors are stored once, with their k + 1 smallest ids: no other copy can be
among a query's k nearest, so this loses nothing, and a vector that a third of all rows
hold costs one posting. A list of over `BIN_ROWS` rows is split into shards, small
neighbouring lists share a bin; a task joins the postings of a bin with the queries
that chose its lists and returns k + 1 per query. Queries of a bin are dealt to several
tasks, by a hash of their ids, where there are many. Scores are cosines of the original
vectors in double precision, by one formula: a task scores by a faster product first and
then again whatever comes within its error of the k + 1 best.

The index on the driver and in the tasks (centroids, graph, list sizes) is bounded by
`most_lists`: the number of lists grows with the vectors up to there, and beyond that
the lists grow. Defined results: null ids, and vectors that are null, empty, zero or hold
null or non-finite components take no part, nor do vectors of another length than the
most frequent one; fewer than k candidates give all of them; equal scores go to smaller
ids; repeated rows count once; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix64, remove

SAMPLE_ROWS = 131_072
SAMPLE_VALUES = 8_000_000  # at most so many numbers on the driver
LIST_ROWS = 24
MOST_LISTS = 16_384
DEGREE = 16
REPLICAS = 3
REPLICA_RATIO = 1.1
RECALL = 0.96
#: Rows of the sample that the ratio is fitted on.
FITTED_ROWS = 512
BIN_ROWS = 8192
BIN_QUERIES = 4096
#: An upper bound of the error of a product of two vectors of unit length, for any usual number of dimensions.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & good & F.exists(vector, lambda x: x != 0)


@dataclass
class CentroidGraph:
    centroids: np.ndarray  # lists x dimensions, unit length
    starts: np.ndarray  # where each centroid's links begin, and where the last one's end
    links: np.ndarray  # numbers of near centroids, and of those that this one is near to
    entry: int

    def within(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, distance) of all centroids met by walking the graph and within ratio times a row's least distance, by row and list.

        What is held is the centroids met, as pairs (row, list) in one sorted array.
        """
        n, c = len(x), len(self.centroids)
        pairs = np.arange(n, dtype=np.int64) * c + self.entry
        dist = self._distances(x, pairs)
        done = np.zeros(n, bool)
        while True:
            row = pairs // c
            leads = np.searchsorted(row, np.arange(n))
            least = np.minimum.reduceat(dist, leads)
            is_least = dist == least[row]
            # descend first: while a row has nearer nodes to expand, only its nearest counts
            fresh = np.logical_or.reduceat(is_least & ~done, leads)
            front = ~done & np.where(fresh[row], is_least, dist <= least[row] * ratio)
            if not front.any():
                break
            done |= front
            near = np.unique(self._linked(row[front], pairs[front] % c))
            at = np.minimum(np.searchsorted(pairs, near), len(pairs) - 1)
            near = near[pairs[at] != near]
            both = np.concatenate([pairs, near])
            order = np.argsort(both, kind="stable")
            pairs = both[order]
            dist = np.concatenate([dist, self._distances(x, near)])[order]
            done = np.concatenate([done, np.zeros(len(near), bool)])[order]
        keep = dist <= least[row] * ratio
        return row[keep], pairs[keep] % c, dist[keep]

    def _linked(self, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The pairs (row, list) one link on from those given."""
        n = self.starts[node + 1] - self.starts[node]
        at = np.repeat(self.starts[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(row * len(self.centroids), n) + self.links[at]

    def _distances(self, x: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        out = np.empty(len(pairs), np.float32)
        for i in range(0, len(pairs), 1 << 16):
            r, k = np.divmod(pairs[i : i + (1 << 16)], len(self.centroids))
            out[i : i + len(r)] = np.linalg.norm(x[r] - self.centroids[k], axis=1)
        return out


def unit(x: np.ndarray) -> np.ndarray:
    x = halved(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def halved(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its squares don't overflow; directions stay exactly as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The score: sums from the first component to the last, in double precision."""
    q, x = halved(q[None, :]), halved(x)
    total = lambda v: np.cumsum(v, axis=1)[:, -1]
    return total(q * x) / (np.sqrt(total(q * q)) * np.sqrt(total(x * x)))


def balanced_leaves(x: np.ndarray, leaf: int, most: int, seed: int = 7) -> list[np.ndarray]:
    """Row numbers of leaves of at most about `leaf` rows: the largest part is split in two halves of near equal size."""
    import heapq

    rng = np.random.default_rng(seed)
    heap, order = [(-len(x), 0, np.arange(len(x)))], 1
    while -heap[0][0] > leaf and len(heap) < most:
        _, _, rows = heapq.heappop(heap)
        part = x[rows]
        a, b = part[rng.integers(len(part))], part[rng.integers(len(part))]
        for _ in range(4):
            side = part @ (a - b)
            cut = np.clip(np.median(side) if abs((side > 0).mean() - 0.5) > 0.25 else 0.0, side.min(), side.max())
            left = side > cut
            if not 0 < left.sum() < len(part):
                left = np.arange(len(part)) < len(part) // 2
            a, b = part[left].mean(0), part[~left].mean(0)
        for own in (rows[left], rows[~left]):
            heapq.heappush(heap, (-len(own), order, own))
            order += 1
    return [rows for _, _, rows in heap]


def refined(x: np.ndarray, centroids: np.ndarray, rounds: int = 5, pull: float = 0.02) -> np.ndarray:
    """Centroids after rounds of k-means on the sphere; a centroid of twice the mean load looks `pull` farther away."""
    load = np.ones(len(centroids))
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[i : i + 1024] @ centroids.T - pull * load, axis=1) for i in range(0, len(x), 1024)])
        load = 0.5 * load + 0.5 * np.bincount(own, minlength=len(centroids)) * len(centroids) / len(x)
        order = np.argsort(own, kind="stable")
        numbers, at = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(x[order], at)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids[numbers] = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centroids[numbers])
    return centroids


def build_graph(sample: np.ndarray, n_vectors: int, list_rows: int = LIST_ROWS, most_lists: int = MOST_LISTS, degree: int = DEGREE) -> CentroidGraph:
    x = unit(sample.astype(np.float64))
    lists = int(np.clip(n_vectors // list_rows, 1, most_lists))
    leaves = balanced_leaves(x, max(1, -(-len(x) // lists)), lists)
    means = np.array([x[rows].mean(0) for rows in leaves])
    norms = np.linalg.norm(means, axis=1, keepdims=True)
    centroids = refined(x, np.where(norms > 1e-9, means / np.maximum(norms, 1e-9), x[[rows[0] for rows in leaves]]))
    near = np.zeros((len(centroids), 0), int)
    if len(centroids) > 1:
        k = min(degree, len(centroids) - 1)
        parts = []
        for i in range(0, len(centroids), 512):
            s = centroids[i : i + 512] @ centroids.T
            s[np.arange(len(s)), i + np.arange(len(s))] = -np.inf
            parts.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
        near = np.vstack(parts)
    far = np.random.default_rng(11).integers(0, len(centroids), (len(centroids), 4))  # long links keep the graph in one piece
    ring = ((np.arange(len(centroids)) + 1) % len(centroids))[:, None]
    links = np.hstack([near, far, ring])
    out, into = np.repeat(np.arange(len(links)), links.shape[1]), links.ravel()
    both = np.unique(np.concatenate([out * len(links) + into, into * len(links) + out]))  # both ways: few centroids are near to an outlying one
    starts = np.searchsorted(both, np.arange(len(links) + 1) * len(links))
    return CentroidGraph(centroids.astype(np.float32), starts, both % len(links), int((centroids @ centroids.mean(0)).argmax()))


def vectors_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def assign(graph: CentroidGraph, x: np.ndarray, replicas: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: the nearest centroid and, for boundary vectors, others that are nearly as near."""
    rows, nodes, dist = graph.within(unit(x).astype(np.float32), ratio)
    order = np.lexsort((dist, rows))
    rows, nodes, dist = rows[order], nodes[order], dist[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    chosen = np.full((len(x), replicas), -1)
    count = np.zeros(len(x), np.int64)
    for p in range(int(place.max()) + 1):  # each row's p-th nearest, for all rows at once
        at = np.flatnonzero(place == p)
        at = at[count[rows[at]] < replicas]
        own = chosen[rows[at]]
        apart = np.linalg.norm(graph.centroids[own] - graph.centroids[nodes[at]][:, None, :], axis=2)
        at = at[np.where(own >= 0, apart, np.inf).min(1) > dist[at]]
        chosen[rows[at], count[rows[at]]] = nodes[at]
        count[rows[at]] += 1
    row, slot = np.nonzero(chosen >= 0)
    return row, chosen[row, slot]


def fitted_ratio(graph: CentroidGraph, sample: np.ndarray, k: int, replicas: int, recall: float = RECALL) -> float:
    """The least ratio at which a walk's lists hold that share of the k nearest rows of the sample's rows."""
    x = unit(sample)
    asked = np.unique(np.linspace(0, len(x) - 1, FITTED_ROWS).astype(int))
    k = min(k, len(x) - 1)
    if not k:
        return 1.0
    nearest = []
    for i in asked:
        near = x @ x[i]
        near[i] = -np.inf
        nearest.append(np.argpartition(-near, k - 1)[:k])
    nearest = np.array(nearest)
    rows, lists = assign(graph, sample[nearest.ravel()], replicas, REPLICA_RATIO)
    far = np.sqrt(np.maximum(0, 2 - 2 * x[asked] @ graph.centroids.T))
    ratio = np.maximum(far[rows // k, lists], 1e-9) / np.maximum(far.min(1)[rows // k], 1e-9)
    needed = np.minimum.reduceat(ratio, np.searchsorted(rows, np.arange(nearest.size)))
    return float(np.quantile(needed, recall)) * 1.001


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    search_ratio: float | None = None,
    replicas: int = REPLICAS,
    most_lists: int = MOST_LISTS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of queries among the other rows of vectors.

    queries has the columns of vectors; a candidate with the query's own id is left out.
    search_ratio: None to fit it on the sample.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    distinct, kept = distinct_vectors(vectors, k, id_col, vector_col)
    sizes = distinct.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    d, n = sizes[0]["d"], sizes[0]["n"]
    distinct = distinct.where(F.size("v") == d)
    most = max(1, min(sample_rows, SAMPLE_VALUES // d))
    share = min(1.0, most / n)
    sample = distinct.where(F.pmod(F.xxhash64("uid", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * share) + 1).select("v").limit(2 * most)
    drawn = vectors_of(sample.toArrow().column(0).combine_chunks())
    graph = build_graph(drawn, n, most_lists=min(most_lists, max(1, len(drawn) // 4)))
    reach = search_ratio or fitted_ratio(graph, drawn, k, replicas)
    shared = spark.sparkContext.broadcast(graph)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                rows, lists = assign(shared.value, vectors_of(part.column(1)), replicas, REPLICA_RATIO)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *(c.take(pa.array(rows)) for c in part.columns)], names=["list", "uid", "v"])

    postings, postings_at = materialize(distinct.select("uid", "v").mapInArrow(post, "list int, uid long, v array<double>"), "postings")
    loads = {r["list"]: r["n"] for r in postings.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most most_lists rows
    first, shards = bins(loads)
    layout = spark.sparkContext.broadcast((first, shards))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, shards = layout.value
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                rows, lists, _ = shared.value.within(unit(vectors_of(part.column(1))).astype(np.float32), reach)
                chosen: dict[tuple[int, int], list[int]] = {}
                for r, x in zip(rows.tolist(), lists.tolist(), strict=True):
                    for s in range(shards.get(x, 0)):
                        chosen.setdefault((r, first[x] + s), []).append(x)
                at = pa.array([r for r, _ in chosen], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([b for _, b in chosen], pa.int32()), *(c.take(at) for c in part.columns), pa.array(list(chosen.values()), pa.list_(pa.int32()))], names=["bin", "quid", "q", "lists"])

    query_rows = clean(queries, id_col, vector_col).where(F.size("v") == d)
    query_vectors, queries_at = materialize(query_rows.groupBy("v").agg(F.min("id").alias("quid")), "query-vectors")
    asked, asked_at = materialize(query_vectors.select("quid", F.col("v").alias("q")).mapInArrow(choose, "bin int, quid long, q array<double>, lists array<int>"), "asked")
    spread = asked.groupBy("bin").agg(F.ceil(F.count("*") / BIN_QUERIES).cast("int").alias("parts"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, shards = layout.value
        for batch in batches:
            lists, uids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            shard = mix64(uids.astype(np.uint64)) % np.array([shards[x] for x in lists.tolist()], np.uint64) if len(lists) else uids
            bin_no = np.array([first[x] for x in lists.tolist()], np.int64) + shard.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bin_no, pa.int32()), *batch.columns], names=["bin", "list", "uid", "v"])

    dealt = postings.mapInArrow(deal, "bin int, list int, uid long, v array<double>").join(spread, "bin").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asking = asked.join(spread, "bin").withColumn("part", F.pmod(F.xxhash64("quid"), F.col("parts")).cast("int"))
    scan = scanner(k)
    near = asking.select("bin", "part", "quid", "q", "lists").groupBy("bin", "part").cogroup(dealt.select("bin", "part", "list", "uid", "v").groupBy("bin", "part")).applyInArrow(scan, "quid long, uid long, score double")
    near, near_at = materialize(near, "near")
    best = near.distinct().withColumn("place", F.row_number().over(Window.partitionBy("quid").orderBy(F.desc("score"), "uid"))).where(F.col("place") <= k + 1)
    each_id = best.join(distinct.select("uid", "ids"), "uid").select("quid", "score", F.explode("ids").alias("vec_id"))
    kept_ids = each_id.withColumn("place", F.row_number().over(Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    lists = kept_ids.groupBy("quid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("found"))
    each = query_rows.select(F.col("id").alias("query_id"), "v").dropDuplicates(["query_id", "v"])
    each = each.join(query_vectors.join(lists, "quid").select("v", "found"), "v")
    own = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    found = each.select("query_id", F.posexplode(own).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", (-F.col("x.far")).alias("score"))
    result, _ = materialize(found, "neighbours")
    remove(spark, kept, postings_at, queries_at, asked_at, near_at)
    return result


def clean(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v of the rows that take part."""
    return df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def distinct_vectors(vectors: DataFrame, k: int, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """uid (the least), ids (the k + 1 least) and v of each different vector."""
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    # the window keeps k + 1 ids of a vector in each map task already, before the shuffle
    rows = clean(vectors, id_col, vector_col).withColumn("place", place).where(F.col("place") <= k + 1)
    rows = rows.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return materialize(rows.select(F.element_at("ids", 1).alias("uid"), "ids", "v"), "distinct-vectors")


def bins(loads: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """The first bin and the number of shards of each list: neighbouring leaves share a bin, a long list has bins of its own."""
    first, shards, bin_no, load = {}, {}, 0, 0
    for x in sorted(loads):
        shards[x] = -(-loads[x] // BIN_ROWS)
        if shards[x] > 1 or load + loads[x] > BIN_ROWS:
            bin_no, load = bin_no + (load > 0), 0
        first[x], load = bin_no, load + loads[x]
        if shards[x] > 1:
            bin_no, load = bin_no + shards[x], 0
    return first, shards


def scanner(k: int):
    """A function that finds the k + 1 best postings of a bin for each query among the lists that it chose."""

    def scan(queries: pa.Table, posts: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if posts.num_rows and queries.num_rows:
            original = vectors_of(posts.column("v").combine_chunks())
            x = unit(original)
            lists, uids = posts.column("list").to_numpy(), posts.column("uid").to_numpy()
            asked = vectors_of(queries.column("q").combine_chunks())
            q, wanted, quids = unit(asked), queries.column("lists").to_pylist(), queries.column("quid").to_pylist()
            numbers, at = np.unique(lists, return_inverse=True)
            for i in range(0, len(q), 64):
                score = q[i : i + 64] @ x.T
                for j in range(i, min(i + 64, len(q))):
                    mine = np.flatnonzero(np.isin(numbers, wanted[j])[at])
                    mine = mine[np.unique(uids[mine], return_index=True)[1]]  # a vector's replicas once
                    s = score[j - i, mine]
                    if len(mine) > k + 1:
                        mine = mine[s >= np.partition(s, -(k + 1))[-(k + 1)] - SLACK]
                    exact = cosines(asked[j], original[mine])
                    for t in np.lexsort((uids[mine], -exact))[: k + 1]:
                        found.append((quids[j], int(uids[mine[t]]), float(exact[t])))
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({"quid": pa.array(cols[0], pa.int64()), "uid": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return scan
