"""Exact vector search over (id, vector) tables: nearest, range, batches, attributes, quantisers, semantic cache."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import DISTANCES, cosine_distance, dot, hamming, sign_bits, similarity, sq8, sq8_decode, vector


def nearest(rows: DataFrame, query: Column, k: int, metric: str = "l2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """KNN: the k nearest rows of one query; ties to smaller ids. Each task keeps k rows, then one merges them."""
    scored = rows.withColumn("distance", DISTANCES[metric](F.col(vector_col), query))
    return scored.orderBy("distance", id_col).limit(k)


def nearest_chunks(chunks: DataFrame, query: Column, k: int, metric: str = "l2", id_col: str = "doc_id", vector_col: str = "embedding") -> DataFrame:
    """KNN of documents that have several vectors: the least distance counts."""
    scored = chunks.groupBy(id_col).agg(F.min(DISTANCES[metric](F.col(vector_col), query)).alias("distance"))
    return scored.orderBy("distance", id_col).limit(k)


def within(rows: DataFrame, query: Column, radius: float, metric: str = "l2", vector_col: str = "embedding") -> DataFrame:
    """VECTOR_RANGE."""
    return rows.withColumn("distance", DISTANCES[metric](F.col(vector_col), query)).where(F.col("distance") <= radius)


#: Rows and queries of a tile at most, rows of one that is cut smaller so that all cores have work, and distances held at a time.
TILE_ROWS, TILE_QUERIES, LEAST_TILE, STRIP = 32_768, 8_192, 2_048, 1 << 22


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, zero at their ends, and their lengths: -1 where the vector or one of its values is null."""
    lists = column.combine_chunks()
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    data = np.zeros((len(lists), int(size.max(initial=0))))
    own = np.arange(data.shape[1]) < size[:, None]
    data[own] = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    gone = lists.is_null().to_numpy(zero_copy_only=False)
    if flat.null_count:
        holes = np.zeros(own.shape, dtype=bool)
        holes[own] = flat.is_null().to_numpy(zero_copy_only=False)
        gone = gone | holes.any(1)
    return data, np.where(gone, -1, size)


def _distances(metric: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distances of functions/columns.py between rows of x and y: the same sums in the same order."""

    def sums(term) -> np.ndarray:
        total = np.zeros(len(x))
        for d in range(x.shape[1]):
            total += term(x[:, d], y[:, d])
        return total

    if metric == "l2":
        return np.sqrt(sums(lambda a, b: (a - b) * (a - b)))
    dot = sums(lambda a, b: a * b)
    if metric == "ip":
        return -dot
    norm = np.sqrt(sums(lambda a, _: a * a) * sums(lambda _, b: b * b))
    far = 1.0 - dot / np.where(norm == 0, 1.0, norm)
    return np.where(norm == 0, 1.0, np.where(far < 0.0, 0.0, far))


def _first_of_equal(data: np.ndarray, size: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among a query's k nearest: of equal vectors those of the k + 1 least ids, as one may be the query's own."""
    wide = np.ascontiguousarray(np.column_stack([data + 0.0, size.astype(np.float64)]))
    kind = np.unique(wide.view(f"V{wide.shape[1] * 8}").ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ids, kind))
    first = np.append(True, np.diff(kind[order]) != 0)
    other = first | np.append(True, ids[order][1:] != ids[order][:-1])
    place = np.cumsum(other)
    start = np.maximum.accumulate(np.where(first, place, 0))
    return np.sort(order[place - start <= k])


def _tile(metric: str, k: int, out: pa.Schema):
    """The k nearest rows of each query within a tile. Matrix products leave the rows that could be among them, whatever the products'
    rounding; those get the exact distance, by which they are ordered (nulls last), ties to smaller ids."""

    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(rows) or not len(queries):
            return out.empty_table()
        y, y_size = _matrix(rows["_v"])
        ids = rows["_id"].to_numpy()
        with np.errstate(all="ignore"):
            kept = _first_of_equal(y, y_size, ids, k)
            y, y_size, ids = y[kept], y_size[kept], ids[kept]
            x, x_size = _matrix(queries["_v"])
            asked = queries["_id"].to_numpy()
            wide = max(x.shape[1], y.shape[1])
            x, y = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (x, y))
            plain = [np.isfinite(8.0 * (m * m).sum(1)) & (n == wide) for m, n in ((x, x_size), (y, y_size))]
            near = []
            for m, fine in zip((x, y), plain, strict=True):
                m = np.where(fine[:, None], m, 0.0)
                if metric == "cosine":
                    norm = np.sqrt((m * m).sum(1))
                    m = m / np.where(norm == 0, 1.0, norm)[:, None]
                near.append(m)
            xn, yn = near
            xx, yy = (xn * xn).sum(1), (yn * yn).sum(1)
            # Rows that matrix products say nothing of and that may be nearest: products that aren't finite, cosines of missing vectors (0, as in SQL).
            loose = {"ip": ~plain[1] & (y_size == wide), "cosine": y_size != wide}.get(metric, np.zeros(len(y), dtype=bool))
            slack = 8 * (wide + 8) * 2.0**-53
            order = np.argsort(ids, kind="stable")
            found: list[list[np.ndarray]] = []
            step = max(1, STRIP // max(1, len(ids)))
            for at in range(0, len(asked), step):
                cut = slice(at, at + step)
                low = xn[cut] @ yn.T
                if metric == "l2":
                    low *= -2.0
                    low += (1.0 - slack) * yy
                    low += (1.0 - slack) * xx[cut, None]
                else:
                    np.negative(low, out=low)
                    low -= slack * (xx[cut, None] + yy)
                low[:, ~plain[1]] = np.inf
                low[~plain[0][cut]] = np.inf
                own = [np.searchsorted(ids, asked[cut], side, sorter=order) for side in ("left", "right")]
                for i in np.flatnonzero(own[1] > own[0]):
                    low[i, order[own[0][i] : own[1][i]]] = np.nan
                if len(ids) > k:
                    bound = np.partition(low, k - 1, axis=1)[:, k - 1]
                    q, r = np.nonzero(low <= bound[:, None])
                    top = np.full(len(low), -np.inf)
                    np.maximum.at(top, q, low[q, r] + 2 * slack * (xx[cut][q] + yy[r]))
                    top[np.isnan(bound)] = np.inf
                    hit = low <= top[:, None]
                    if loose.any():
                        hit[:, loose] = True
                        hit &= ~np.isnan(low)
                    q, r = np.nonzero(hit)
                else:
                    q, r = np.nonzero(~np.isnan(low))
                for part in range(0, len(q), STRIP // 16):
                    a, b = q[part : part + STRIP // 16] + at, r[part : part + STRIP // 16]
                    far = _distances(metric, x[a], y[b])
                    none = (x_size[a] != y_size[b]) | (x_size[a] < 0)
                    if metric == "cosine":
                        far = np.where(none & ((x_size[a] < 0) | (y_size[b] < 0) | (x.any(1)[a] & y.any(1)[b])), 0.0, far)
                        none = np.zeros(len(a), dtype=bool)
                    found.append([a, ids[b], np.where(none, 0.0, far), none])
        if not found:
            return out.empty_table()
        a, b, far, none = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((b, far, none, a))
        a, b, far, none = a[order], b[order], far[order], none[order]
        first = np.append(True, np.diff(a) != 0)
        place = np.arange(len(a))
        best = place - np.maximum.accumulate(np.where(first, place, 0)) < k
        return pa.table([pa.array(asked[a[best]]), pa.array(b[best]), pa.array(far[best], mask=none[best])], schema=out)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            both = pa.Table.from_batches(held)
            for tile in pc.unique(both["_tile"]):
                own = both.filter(pc.equal(both["_tile"], tile))
                yield from search(own.filter(pc.invert(own["_asks"])), own.filter(own["_asks"])).to_batches(max_chunksize=65_536)

    return tiles


def nearest_per_query(rows: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """KNN for a stated set of queries against all rows: query_id, rank, id (integers), distance. Rows and queries are dealt into
    tiles of bounded size, each pair of blocks in one task; a tile gives k rows of a query, and a window merges them. No distance is last."""
    n, asked = rows.count(), queries.count()
    across = max(1, -(-asked // TILE_QUERIES))
    spread = min(-(-n // LEAST_TILE), -(-4 * rows.sparkSession.sparkContext.defaultParallelism // across))
    down = max(1, -(-n // TILE_ROWS), spread)
    block = lambda df, n: df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_v"), F.pmod(F.xxhash64(id_col), F.lit(n)).alias("_own"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = block(rows, down).select("_id", "_v", F.lit(False).alias("_asks"), "_own", every(across).alias("_other")).withColumn("_tile", (F.col("_other") * down + F.col("_own")).cast("int"))
    asks = block(queries, across).select("_id", "_v", F.lit(True).alias("_asks"), "_own", every(down).alias("_other")).withColumn("_tile", (F.col("_own") * down + F.col("_other")).cast("int"))
    both = dealt.unionByName(asks).select("_id", "_v", "_asks", "_tile").repartitionById(across * down, "_tile")
    out = pa.schema([("query_id", pa.int64()), ("_id", pa.int64()), ("distance", pa.float64())])
    found = both.mapInArrow(_tile(metric, k, out), "query_id long, _id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select(F.col("query_id").cast(queries.schema[id_col].dataType).alias("query_id"), F.col("_id").cast(rows.schema[id_col].dataType).alias(id_col), "distance", "rank")


def similar(rows: DataFrame, query: Column, k: int, test: Column | None = None, epsilon: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """VSIM: cosine similarity mapped to 0 .. 1, with an attribute filter and a least score of 1 - epsilon."""
    if test is not None:
        rows = rows.where(F.coalesce(test, F.lit(False)))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - cosine_distance(F.col(vector_col), query) / 2.0))
    scored = rows.withColumn("score", score)
    if epsilon is not None:
        scored = scored.where(F.col("score") >= 1.0 - epsilon)
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def binary_nearest(rows: DataFrame, query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Nearest by the Hamming distance of sign bits."""
    scored = rows.withColumn("distance", hamming(sign_bits(F.col(vector_col)), sign_bits(query)))
    return scored.orderBy("distance", id_col).limit(k)


def product_codebooks(rows: DataFrame, parts: int, codes: int, vector_col: str = "embedding", seed: int = 1):
    """A k-means codebook for each part of the vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    size = len(rows.select(vector_col).first()[0]) // parts
    cut = lambda p: array_to_vector(F.transform(F.slice(vector_col, p * size + 1, size), lambda x: x.cast("double")))
    return [KMeans(k=codes, seed=seed, featuresCol="part").fit(rows.select(cut(p).alias("part"))) for p in range(parts)]


def product_codes(rows: DataFrame, models: list, vector_col: str = "embedding") -> DataFrame:
    """Each row with its code in each part's book."""
    from pyspark.ml.functions import array_to_vector

    size = len(models[0].clusterCenters()[0])
    for p, model in enumerate(models):
        part = rows.withColumn("part", array_to_vector(F.transform(F.slice(vector_col, p * size + 1, size), lambda x: x.cast("double"))))
        rows = model.copy({model.predictionCol: f"code_{p}"}).transform(part).drop("part")
    return rows


def projection_matrix(dims: int, size: int, seed: int = 3) -> list[list[float]]:
    """Rows of a seeded Gaussian projection."""
    import random

    rng = random.Random(seed)
    return [[rng.gauss(0, 1) / dims**0.5 for _ in range(size)] for _ in range(dims)]


def random_projection(rows: DataFrame, dims: int, vector_col: str = "embedding", size: int = 64, seed: int = 3) -> DataFrame:
    """REDUCE: Gaussian random projection to dims values."""
    parts = [dot(F.col(vector_col), vector(row)) for row in projection_matrix(dims, size, seed)]
    return rows.withColumn(vector_col, F.array(*parts))


def quantised_nearest(rows: DataFrame, query: Column, k: int, metric: str = "l2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """KNN over 8-bit codes: distances to what the codes decode to."""
    low, high = F.array_min(vector_col).cast("double"), F.array_max(vector_col).cast("double")
    decoded_ = rows.withColumn("_v", sq8_decode(sq8(F.col(vector_col)), low, high))
    return decoded_.withColumn("distance", DISTANCES[metric](F.col("_v"), query)).drop("_v").orderBy("distance", id_col).limit(k)


def cached_answer(cache: DataFrame, query: Column, as_of_ms: int, scope: str | None = None, threshold: float = 0.9, id_col: str = "entry_id", vector_col: str = "embedding") -> DataFrame:
    """SEMANTIC.GET: the best live entry of the scope whose cosine similarity reaches the threshold."""
    rows = cache.where(F.col("expire_at").isNull() | (F.col("expire_at") > as_of_ms))
    if scope is not None:
        rows = rows.where(F.col("scope") == scope)
    scored = rows.withColumn("similarity", similarity("cosine", cosine_distance(F.col(vector_col), query)))
    return scored.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), id_col).limit(1)


# ------------------------------------------------------------------- vector sets: rows (key, elem, embedding, attrs)


def put(rows: DataFrame, new: DataFrame, key: str = "key", elem: str = "elem") -> DataFrame:
    """VADD: the rows with those of new, which replace elements of the same name."""
    return rows.join(new.select(key, elem), [key, elem], "left_anti").unionByName(new.select(*rows.columns))


def remove(rows: DataFrame, gone: DataFrame, key: str = "key", elem: str = "elem") -> DataFrame:
    """VREM."""
    return rows.join(gone.select(key, elem), [key, elem], "left_anti")


def look_up(rows: DataFrame, request: DataFrame, *fields: str, key: str = "key", elem: str = "elem") -> DataFrame:
    """VEMB, VGETATTR, VISMEMBER: each requested element with its fields (null if there is none) and whether it is a member."""
    there = rows.select(key, elem, *fields, F.lit(True).alias("_there"))
    return request.join(there, [key, elem], "left").withColumn("is_member", F.coalesce("_there", F.lit(False))).drop("_there")


def set_attributes(rows: DataFrame, new: DataFrame, key: str = "key", elem: str = "elem", attrs: str = "attrs") -> DataFrame:
    """VSETATTR: elements of new (key, elem, attrs) get its attributes; an empty text clears them."""
    fresh = new.select(key, elem, F.col(attrs).alias("_attrs"), F.lit(True).alias("_set"))
    value = F.when(F.col("_set"), F.nullif(F.col("_attrs"), F.lit(""))).otherwise(F.col(attrs))
    return rows.join(fresh, [key, elem], "left").withColumn(attrs, value).select(*rows.columns)


def random_members(rows: DataFrame, count: int, seed: int, key: str = "key", elem: str = "elem") -> DataFrame:
    """VRANDMEMBER."""
    from .sets import sample

    return sample(rows, count, seed, key, elem)


def neighbours_of(rows: DataFrame, request: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """VLINKS: the exact neighbours of the requested elements, in place of an index's links."""
    return nearest_per_query(rows, rows.join(request.select(id_col), id_col, "left_semi"), k, metric, id_col, vector_col)


def code_distances(codes: DataFrame, books: list, query: list[float], id_col: str = "vec_id") -> DataFrame:
    """Distances of product codes to a query (squared, by lookup): the query's distances to each book's centres are constants of the plan."""
    total = None
    for p, model in enumerate(books):
        centres = model.clusterCenters()
        size = len(centres[0])
        part = query[p * size : (p + 1) * size]
        table = F.array(*(F.lit(float(sum((a - b) ** 2 for a, b in zip(part, c, strict=True)))) for c in centres))
        own = F.element_at(table, F.col(f"code_{p}") + 1)
        total = own if total is None else total + own
    return codes.select(id_col, total.alias("distance"))


def decoded(blob: Column, kind: str, dim: int = 0) -> Column:
    """A typed vector: little-endian FLOAT32, FLOAT64, FLOAT16, BFLOAT16, INT8 or UINT8 bytes, or text as "1,2,3" or "[1, 2, 3]";
    null where it isn't exactly dim (0: any number) finite components. Text that reads as numbers comes first."""
    types = {"FLOAT32": "<f4", "FLOAT64": "<f8", "FLOAT16": "<f2", "BFLOAT16": "<u2", "INT8": "i1", "UINT8": "u1"}
    dtype = np.dtype(types[kind])

    def one(data: bytes | None) -> list[float] | None:
        if not data:
            return None
        found = None
        if not data.translate(None, b"0123456789.,-+eE[] \t\n\x0b\x0c\r"):
            try:
                found = [float(t) for t in data.decode().translate(str.maketrans(",[]", "   ")).split()] or None
            except ValueError:
                found = None
        if found is None or dim and len(found) != dim:
            if len(data) % dtype.itemsize or dim and len(data) != dim * dtype.itemsize:
                return None
            raw = np.frombuffer(data, dtype)
            found = (raw.astype("<u4") << 16).view("<f4") if kind == "BFLOAT16" else raw
        with np.errstate(over="ignore"):
            values = np.asarray(found).astype(np.float32)
        return values.tolist() if np.isfinite(values).all() else None

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def decode(column: pa.Array) -> pa.Array:
        return pa.array([one(x) for x in column.cast(pa.binary()).to_pylist()], pa.list_(pa.float32()))

    return decode(blob)


# ------------------------------------------------------------------- semantic cache: rows (ns, entry_id, prompt, response, embedding, scope, expire_at, tokens)


def cache_put(cache: DataFrame, new: DataFrame, key: str = "entry_id") -> DataFrame:
    """SEMANTIC.SET."""
    return cache.join(new.select("ns", key), ["ns", key], "left_anti").unionByName(new.select(*cache.columns))


def cache_delete(cache: DataFrame, gone: DataFrame, key: str = "entry_id") -> DataFrame:
    """SEMANTIC.DEL."""
    return cache.join(gone.select("ns", key), ["ns", key], "left_anti")


def cache_flush(cache: DataFrame, ns: str) -> DataFrame:
    """SEMANTIC.FLUSH."""
    return cache.where(F.col("ns") != ns)


def cache_info(cache: DataFrame, asked: DataFrame, as_of_ms: int) -> DataFrame:
    """SEMANTIC.INFO of each namespace: live entries; hits, misses and tokens saved of the log of gets (ns, hit, tokens)."""
    live = cache.where(F.col("expire_at").isNull() | (F.col("expire_at") > as_of_ms)).groupBy("ns").agg(F.count("*").alias("entries"))
    log = asked.groupBy("ns").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.sum(F.when(F.col("hit"), F.col("tokens")).otherwise(0)).alias("tokens_saved"))
    return live.join(log, "ns", "full_outer").select("ns", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("entries", "hits", "misses", "tokens_saved")))
