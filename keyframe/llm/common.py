"""Helpers shared by the corpus operators: shared scratch tables and vectorised text kernels.

The kernels work on the Arrow buffers of a string column (one byte array and its
offsets), a bounded slice at a time, so a task holds a few megabytes of expanded text
whatever the number of rows in a batch; a longer text is a slice of its own, and some
kernels expand it to about ten times its size.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel expands at a time.
SLICE_BYTES = 1 << 18
#: Rows of text that Spark hands to Python at a time.
TEXT_ROWS = 1000
#: Bytes of rows that Spark hands to Python at a time.
BATCH_BYTES = 4 << 20

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_GAP = np.zeros(256, dtype=bool)
WORD_GAP[[32, 9, 10, 11, 12, 13]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: spark.checkpoint.dir. Where it is unset, a local folder, if all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="keyframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/keyframe/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str | None) -> Iterator[None]:
    """Spark settings (dots as double underscores) for the jobs run within; None leaves one as it is."""
    found = {k.replace("__", "."): v for k, v in values.items() if v is not None}
    before = {k: spark.conf.get(k, None) for k in found}
    for k, v in found.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, rows: int | None = None) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    Spark deletes the shuffle files behind it once it is written, as nothing reads them
    any more. rows: Spark hands at most so many to Python at a time, and never more than about BATCH_BYTES.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    batch = None if rows is None else str(rows)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", spark__sql__execution__arrow__maxRecordsPerBatch=batch, spark__sql__execution__arrow__maxBytesPerBatch=str(BATCH_BYTES)):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bound_batches(spark: SparkSession) -> None:
    """From now on Spark hands about BATCH_BYTES of rows to Python at a time in this session, where it isn't told otherwise: for frames that run after their operator has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Memory that this process has freed goes back to the system, as far as the C library can do so: workers live on beside the tasks of other steps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] = lambda: None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, whose worker calls forget and gives back the memory that it has freed when a task is over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            forget()
            give_back()

    return run


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def with_row_keys(docs: DataFrame, key_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a key of its own for each row: the id, or, where an id is null or repeats, the row's number in the order
    of (id, nulls first; text's digest; digest of the row)."""
    ids = docs.groupBy(id_col).agg(F.count("*").alias("n"))
    if ids.where(F.col(id_col).isNull() | (F.col("n") > 1)).isEmpty():
        return docs.withColumn(key_col, F.col(id_col).cast("long"))
    order = [F.asc_nulls_first(id_col), F.asc_nulls_first(F.md5(text_col)), F.xxhash64(*docs.columns)]
    rows, _ = materialize(docs.orderBy(*order).withColumn(key_col, F.monotonically_increasing_id()), "row-keys", TEXT_ROWS)
    part = F.shiftright(key_col, 33)
    sizes = sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    before = [sum(r["n"] for r in sizes[:i]) for i in range(len(sizes))]
    of, ahead = free_name("_part", rows), free_name("_before", rows)
    starts = docs.sparkSession.createDataFrame([(r["part"], b) for r, b in zip(sizes, before, strict=True)], f"{of} long, {ahead} long")
    place = F.col(key_col).bitwiseAND(F.lit((1 << 33) - 1)) + F.col(ahead)
    return rows.join(F.broadcast(starts), part == F.col(of)).withColumn(key_col, place).drop(of, ahead)


def free_name(name: str, *dfs: DataFrame) -> str:
    """name, with underscores before it until no column of dfs has it (names are compared without regard to case)."""
    taken = {c.lower() for df in dfs for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 12) -> Iterator[pa.Table]:
    """Tables of about so many rows or of one larger group, in which the groups of equal keys are whole; batches come in their order."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        start = 0  # of the last group, which may go on in the next batch
        for key in keys:
            value = batch.column(key).to_numpy()
            start = max([start, *(np.flatnonzero(value != value[-1])[-1:] + 1)])
        if start and n + start >= rows:
            yield pa.Table.from_batches([*held, batch.slice(0, start)]).combine_chunks()
            held, n, batch = [], 0, batch.slice(start)
        elif n >= rows and not start and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def held_out(id_col: str = "doc_id"):
    """Rows kept from every fit: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


# ---------------------------------------------------------------- text kernels


def text_column(column: pa.Array) -> pa.Array:
    """A string column without nulls (null becomes empty)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a large_string column without nulls."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])), offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows that hold about `most` bytes, a longer row alone."""
    data, offsets = buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling; kept while n is of usual size."""
    have = _powers.get(base)
    if have is not None and len(have) >= n:
        return have[:n]
    size = max(n, 1024)
    out = np.ones(size, np.uint64)
    k = 1
    with np.errstate(over="ignore"):
        while k < size:
            step = np.uint64(pow(base, k, 1 << 64))
            out[k : 2 * k] = out[: min(k, size - k)] * step
            k *= 2
    if size <= 4 * SLICE_BYTES:
        _powers[base] = out
    return out[:n]


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = WORD_GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of bytes outside `gap`, within rows."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~gap[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of byte spans, equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_CODE[data] * powers(BASE, len(data)), out=total[1:])
        return mix64((total[ends] - total[starts]) * powers(BASE_INV, len(data))[starts] + (ends - starts).astype(np.uint64))


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of `words` words; a row of fewer words has one shingle of all of them, an empty row none."""
    starts, ends, row = word_spans(data, offsets)
    h = span_hashes(data, starts, ends)
    if not len(h):
        return h, row
    n_rows = len(offsets) - 1
    count = np.bincount(row, minlength=n_rows)
    lead = np.concatenate(([0], np.cumsum(count)[:-1]))
    place = np.arange(len(h)) - lead[row]
    with np.errstate(over="ignore"):
        total = np.zeros(len(h), np.uint64)
        for j in range(min(words, len(h))):
            shifted = np.zeros(len(h), np.uint64)
            shifted[: len(h) - j] = h[j:] if j else h
            live = place + j < count[row]
            total += np.where(live, shifted, np.uint64(0)) * np.uint64(pow(0xA0761D6478BD642F, j + 1, 1 << 64))
    keep = np.where(count[row] >= words, place + words <= count[row], place == 0)
    return mix64(total[keep]), row[keep]
