"""Packing along a space-filling curve.

Each text becomes a vector of hashed words, projected to a few dimensions; the place
of that point on a Hilbert curve is its key. Documents are range-sorted by the key and
laid end to end along the curve, cut every `length` tokens, so neighbours share
sequences and only the last sequence of all has padding.

Plan: texts are dealt out by ranges of (key, a digest of the id), which also splits a
large group of equal texts. There is a range for each `RANGE_BYTES` of text, and at least
one for each shuffle partition. The ranges' bounds come from about `SAMPLE` draws for each
range, in which a text counts by its bytes; they only even out the tasks, and so keys are
computed once. Each task sorts its range, encodes it and writes ids with their place in
the range. A row per range gives the ranges' starts. A second pass over the written ids
cuts the pieces. Nothing grows with the data on the driver but one number per range.

Defined results: a null text is empty (its document is the end id alone), a null id
is packed like any other, repeated rows are packed as often as they stand, an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXT_ROWS, giving_back, materialize, slices, span_hashes, text_column, word_spans
from .tokens import encoder

LENGTH = 1024
DIMENSIONS = 4
ORDER = 8  # bits of a key for each dimension
#: Bytes of text in a range, and draws for its bound.
RANGE_BYTES = 64 << 20
SAMPLE = 200


def hilbert(points: np.ndarray, order: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n x dimensions, `order` bits each): Skilling's transform, for all rows at once."""
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    q = np.uint64(1 << (order - 1))
    while q > 1:
        low = q - np.uint64(1)
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= np.uint64(1)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    q = np.uint64(1 << (order - 1))
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - np.uint64(1)), t)
        q >>= np.uint64(1)
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for bit in range(order - 1, -1, -1):
        for i in range(dims):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(bit)) & np.uint64(1))
    return key.astype(np.int64)


def text_points(column: pa.Array, dims: int = DIMENSIONS, order: int = ORDER) -> np.ndarray:
    """Projection of each text's word vector: a word adds +1 or -1 to each dimension by its hash; scaled by the root of the words."""
    out = np.zeros((len(column), dims))
    for first, data, offsets in slices(text_column(column)):
        starts, ends, row = word_spans(data, offsets)
        if not len(row):
            continue
        h = span_hashes(data, starts, ends)
        leads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        rows, count = row[leads], np.diff(np.r_[leads, len(row)])
        for d in range(dims):
            sign = ((h >> np.uint64(d)) & np.uint64(1)).astype(np.int8)
            out[first + rows, d] = (2.0 * np.add.reduceat(sign, leads, dtype=np.int64) - count) / np.sqrt(count)
    spread = 0.5 + 0.5 * np.tanh(out / 2.0)  # to 0 .. 1
    return np.minimum((spread * (1 << order)).astype(np.int64), (1 << order) - 1)


@F.arrow_udf(T.LongType())
def curve_key(texts: pa.Array) -> pa.Array:
    """The Hilbert key of each text."""
    return pa.array(hilbert(text_points(texts), ORDER))


def along_curve(docs: DataFrame, id_col: str, text_col: str, parts: int, total: int) -> DataFrame:
    """doc_id, text, curve_key, tie: dealt to `parts` partitions, in ranges of (curve_key, tie), each range sorted. total: bytes of all texts, with 64 for each."""
    tie = F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 44)  # 20 bits
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), tie.alias("tie"))
    weight = F.octet_length(F.coalesce("text", F.lit(""))) + 64  # an empty text takes room too
    drawn = F.xxhash64("doc_id", "tie", F.lit("range")).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    draws = F.floor(weight * float(SAMPLE * parts / max(1, total)) + drawn).cast("int")
    sample = rows.withColumn("draws", draws).where("draws > 0").select(F.explode(F.array_repeat(F.shiftleft(curve_key("text"), 20).bitwiseOR(F.col("tie")), F.col("draws"))).alias("place"))
    cuts = sample.agg(F.percentile_approx("place", [i / parts for i in range(1, parts)] or [0.5], 10 * parts)).first()[0] or []
    bounds = np.array(sorted(cuts)[: parts - 1], np.int64)

    @F.arrow_udf(T.StructType().add("key", "long").add("part", "integer"))
    def dealt(texts: pa.Array, ties: pa.Array) -> pa.Array:
        key = hilbert(text_points(texts), ORDER)
        part = np.searchsorted(bounds, (key << 20) | ties.to_numpy(), "right")
        return pa.StructArray.from_arrays([pa.array(key), pa.array(part, pa.int32())], ["key", "part"])

    rows = rows.withColumn("at", dealt("text", "tie")).select("doc_id", "text", F.col("at.key").alias("curve_key"), "tie", F.col("at.part").alias("part"))
    return rows.repartitionById(parts, "part").sortWithinPartitions("curve_key", "tie", "doc_id").drop("part")


def encode_along_curve(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, keep: bool = True) -> DataFrame:
    """part, at (tokens before it in its part), doc_id, curve_key, n_tokens, ids: written to the shared folder. keep: a worker keeps the words it has met for its next tasks."""
    total = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + F.lit(64).cast("long"))).first()[0] or 0
    n = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        ends = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                rows = batch.slice(i, 64)
                ids = [x + ends for x in enc.encode([t or "" for t in rows.column(1).to_pylist()])]
                sizes = np.array([len(x) // enc.dtype.itemsize for x in ids], np.int64)
                starts = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), pa.array(starts), rows.column(0), rows.column(2), pa.array(sizes), pa.array([enc.dtype.itemsize] * len(ids), pa.int32()), pa.array(ids, pa.binary())],
                    names=["part", "at", "doc_id", "curve_key", "n_tokens", "width", "ids"],
                )

    coded = along_curve(docs, id_col, text_col, n, total).mapInArrow(encode if keep else giving_back(encode, lambda: encoder(tokenizer).forget()), "part int, at long, doc_id long, curve_key long, n_tokens long, width int, ids binary")
    return materialize(coded, "packed-ids", TEXT_ROWS)[0]


def cut_pieces(coded: DataFrame, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece (and its ids)."""
    totals = coded.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    first = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    starts = totals.select("part", first.alias("first"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, place, n, width, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
                words = np.frombuffer(ids.as_buffer(), f"<u{width}").astype("<u4")
                done = 0
                while done < n:
                    sequence, offset = divmod(place + done, length)
                    k = min(n - done, length - offset)
                    data = words[done : done + k].tobytes()
                    rows.append((doc, done, k, zlib.crc32(data), n, sequence, offset, *([words[done : done + k]] if with_ids else [])))
                    done += k
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 7 + [pa.list_(pa.uint32())] * with_ids
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) if t == pa.int64() else pa.array(c, pa.list_(pa.int64())) for c, t in zip(cols, kinds, strict=True)], names=names + ["ids"] * with_ids)

    placed = coded.join(F.broadcast(starts), "part").select("doc_id", (F.col("first") + F.col("at")).alias("place"), "n_tokens", "width", "ids")
    return placed.mapInArrow(cut, ", ".join(f"{c} long" for c in names) + ", ids array<long>" * with_ids)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: bool = True) -> DataFrame:
    """All documents packed into sequences of at most `length` tokens, a row per piece. keep: workers keep the words they have met, which is faster but takes memory from other steps."""
    return cut_pieces(encode_along_curve(docs, tokenizer, end_id, id_col, text_col, keep=keep), length)
