"""Token ids in Arrow stream files of fixed-size-list batches.

A file holds the tokens of a range of documents, one after the other, as sequences of
one length: column `ids` (fixed-size list of the ids) and column `mask` (fixed-size
list of bool, false on the padding at the end of the file). All record batches but
the last have the same number of sequences, so any sequence is found by arithmetic
and read from the mapped file without a copy. A second file beside it, also an Arrow
stream, lists the documents: doc_id, start in the file, n_tokens.

Documents are dealt to files by ranges of (doc_id, the text's digest), a file for each
`FILE_BYTES` of text and at least one for each shuffle partition. A file has its task's
attempt in its name, and the listing, which Spark commits, names the files of the attempts
that count: a task that runs twice harms nothing, and no file system has to rename. The
position of a file's first token among all is the sum of the files before it, a row
per file. Files go to the folder in spark.checkpoint.dir; pyarrow must be able to open it
(local and shared paths, HDFS, S3, Google Cloud Storage).

Defined results: a null text is empty (one end id), null ids come first, documents of
the same id are ordered by their text's digest, an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TEXT_ROWS, materialize, scratch
from .tokens import encoder

SEQUENCE = 1024
BATCH_SEQUENCES = 256
#: Bytes of text in a file.
FILE_BYTES = 64 << 20


def filesystem(path: str):
    """The pyarrow file system of a path or URI, and the path in it."""
    from pyarrow import fs

    scheme = path.partition(":")[0] if ":" in path else ""
    if scheme in ("s3a", "s3n"):  # Hadoop's names for S3
        path = f"s3{path[3:]}"
    return fs.FileSystem.from_uri(path) if scheme else (fs.LocalFileSystem(), path)


class SequenceWriter:
    """Writes tokens as they come; at most one batch of sequences is held."""

    def __init__(self, path: str, dtype: np.dtype, length: int) -> None:
        self.fs, self.path = filesystem(path)
        self.length, self.dtype = length, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = self.fs.open_output_stream(self.path)
        self.stream = pa.ipc.new_stream(self.out, self.schema)
        self.held = np.zeros(0, dtype)
        self.written = 0

    def _batch(self, ids: np.ndarray, real: int) -> None:
        rows = len(ids) // self.length
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.stream.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema), None)
        self.written += real
        assert rows

    def add(self, ids: np.ndarray) -> None:
        self.held = np.concatenate([self.held, ids])
        step = self.length * BATCH_SEQUENCES
        while len(self.held) >= step:
            self._batch(self.held[:step], step)
            self.held = self.held[step:]

    def close(self) -> int:
        """Tokens written. The last sequence is padded with id 0."""
        if real := len(self.held):
            self._batch(np.concatenate([self.held, np.zeros(-real % self.length, self.dtype)]), real)
        self.stream.close()
        self.out.close()
        return self.written


class SequenceFile:
    """Zero-copy random access to a file's sequences, masks and token ranges."""

    def __init__(self, path: str) -> None:
        fs, inner = filesystem(path)
        from pyarrow import fs as pafs

        source = pa.memory_map(inner) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(inner)
        self.batches = list(pa.ipc.open_stream(source))
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else SEQUENCE
        self.step = self.batches[0].num_rows if self.batches else 1
        self.flat = [b.column(0).flatten().to_numpy() for b in self.batches]  # views of the mapped file
        self.n_tokens = sum(pc.sum(b.column(1).flatten()).as_py() or 0 for b in self.batches)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        b, r = divmod(i, self.step)
        at = r * self.length
        return self.flat[b][at : at + self.length], self.batches[b].column(1).flatten().slice(at, self.length).to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views that make up the ids start .. start + n."""
        per = self.step * self.length
        while n:
            b, at = divmod(start, per)
            part = self.flat[b][at : at + n]
            yield part
            start, n = start + len(part), n - len(part)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, partitions: int | None = None) -> DataFrame:
    """Encode, append end_id, and write in the order of doc_id: part, path, n_docs, n_tokens of each file."""
    spark = docs.sparkSession
    folder = scratch(spark, "token-files")
    if folder.startswith("file:") or "://" not in folder:
        os.makedirs(filesystem(folder)[1], exist_ok=True)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // FILE_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path, enc, sequences = f"{folder}/part-{part:06d}-{TaskContext.get().taskAttemptId()}.arrows", encoder(tokenizer), None
        index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        at = n_docs = 0
        for batch in batches:
            if sequences is None:
                sequences = SequenceWriter(path, enc.dtype, length)
                fs, inner = filesystem(f"{path}.index")
                out = fs.open_output_stream(inner)
                listing = pa.ipc.new_stream(out, index)
            ends = np.array([end_id], enc.dtype).tobytes()
            for i in range(0, batch.num_rows, 64):
                rows = batch.slice(i, 64)
                coded = [np.frombuffer(x + ends, enc.dtype) for x in enc.encode([t or "" for t in rows.column(1).to_pylist()])]
                sizes = np.array([len(x) for x in coded], np.int64)
                starts = at + np.cumsum(sizes) - sizes
                sequences.add(np.concatenate(coded))
                listing.write_batch(pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(starts), pa.array(sizes)], schema=index))
                at, n_docs = at + int(sizes.sum()), n_docs + len(sizes)
        if sequences is not None:
            listing.close()
            out.close()
            sequences.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([n_docs], pa.int64()), pa.array([at], pa.int64())], names=["part", "path", "n_docs", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest")]
    files = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(write, "part int, path string, n_docs long, n_tokens long")
    return materialize(files, "token-files-list", TEXT_ROWS)[0]


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                file = SequenceFile(path)
                fs, inner = filesystem(f"{path}.index")
                with fs.open_input_stream(inner) as source, pa.ipc.open_stream(source) as index:
                    for rows in index:
                        sums = []
                        for start, n in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                            crc = 0
                            for part in file.tokens(start, n):
                                crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                            sums.append(crc)
                        yield pa.RecordBatch.from_arrays([rows.column(0), pc.add(rows.column(1), before), rows.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row per file: a running sum over the file list, not over the data
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.withColumn("before", before).select("part", "path", "before")
    return placed.repartition(files.count() or 1, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return read_token_files(write_token_files(docs, tokenizer, end_id, id_col, text_col))


def open_files(spark: SparkSession, files: DataFrame) -> list[SequenceFile]:
    """The files of a (small) listing, for random access from the driver or a trainer."""
    return [SequenceFile(r["path"]) for r in files.orderBy("part").select("path").toLocalIterator()]
