"""Repeated substrings by distributed prefix doubling.

Every byte covered by a `length`-byte string that also starts earlier (in a smaller
document, or earlier in the same one) is removed. As in a suffix array built by prefix
doubling, Spark sorts positions by pairs of what they are at one length and at a greater
offset, hands out ranks in that order, and goes on with the ranks at a greater length;
positions drop out once their rank is unique, and it ends at the threshold:

1. 32 bytes. Names of 1, 2, 4 .. 32 bytes are made where the text is. Of the 32-byte names
   in any `length` consecutive bytes, the one with the least name is the anchor. Equal
   strings have equal anchors in the same place, so only anchors are sorted among all
   texts: about 3 in 100 positions. The windows that share an anchor make one run. The
   pair is (anchor, whole text of the run): a run that repeats an earlier one whole is
   removed whole, an anchor that stands once drops out, the others get ranks.
2. `length` - 7 bytes. The runs that are left are cut into blocks of 8 windows, counted
   from the anchor, and sorted by the pair (rank at 32 with the block's place by the
   anchor, name of what all its windows share), and then by their whole text. A block
   that repeats an earlier one whole is removed whole, a pair that stands once drops out,
   the others are reranked.
3. `length` bytes. The windows of the blocks that are left are sorted by the pair (rank of
   the block with the window's place in it, name of the whole window); all but the first
   of a pair are repeats.

Whether two strings are equal is always decided by names of two 64-bit words; single words
only make candidates.

Equal texts are one node: all but the first copy are removed whole (if `length` long),
and only the first goes through the steps. A task remembers the names it has met (up to
a bound, the frequent ones longest) and settles their repeats itself, so a passage that a
third of all documents hold reaches a sorting task about once per map task. Sorting tasks
hold one batch. Long texts are worked on a piece at a time.

Texts go through four exchanges: to leave out equal ones, to name blocks, to name windows
(those that have any left), and to cut the bytes.

Defined results: a null text is empty; texts shorter than `length` stay whole; rows that
repeat an id are documents in the order of their texts' digests (of equal rows one is the
first copy); a null id stands before all others; bytes that are no longer UTF-8 after a cut are hashed as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODE, TEXT_ROWS, materialize, mix64, remove, slices, text_column

LENGTH = 100
ANCHOR = 32
BLOCK = 8
#: Lengths that the names of runs and windows can tell apart.
LEAST_LENGTH, MOST_LENGTH = 64, 112
#: Bytes of text that are named at a time.
PIECE_BYTES = 1 << 20
#: Names that a task remembers.
MOST_SEEN = 1 << 18
#: Kinds of rows: to be ranked, or bytes known to be repeated.
RUN, REPEAT = 0, 1

#: Multipliers of a name's two words; a name of 2n bytes is name(first n) * FACTOR ** n + name(last n).
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def names(data: np.ndarray, length: int, factor: int = FACTORS[0], start: tuple[np.ndarray, int] | None = None) -> np.ndarray:
    """A word of the name of the `length` (a power of two) bytes from each position on, by doubling; start: (names, length) to go on from."""
    name, have = start or (BYTE_CODE[data], 1)
    with np.errstate(over="ignore"):
        while have < length:
            name = name[:-have] * np.uint64(pow(factor, have, 1 << 64)) + name[have:] if len(name) > have else name[:0]
            have *= 2
    return name


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each `width` consecutive values, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, anchor name, anchor place, both words of the whole text's name) of all runs of windows that share an anchor."""
    none, nothing = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) < length:
        return none, none, none, nothing, none, nothing, nothing
    raw = names(data, ANCHOR)
    name = mix64(raw)
    width = length - ANCHOR + 1
    least = sliding(name, width, np.minimum)  # of each window
    n = len(least)
    # candidates are the positions that are the least of some window; a window's anchor is the first of them that has its least
    is_chosen = name == _covering_max(least, width, len(name))
    chosen = np.flatnonzero(is_chosen)
    nxt = np.cumsum(is_chosen)[:n] - is_chosen[:n]
    place = chosen[nxt]
    wrong = np.flatnonzero(name[place] != least)
    while len(wrong):  # a candidate between that is the least of other windows only
        nxt[wrong] += 1
        place[wrong] = chosen[nxt[wrong]]
        wrong = wrong[name[place[wrong]] != least[wrong]]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:n] == row[length - 1 : length - 1 + n]
    first = inside & np.r_[True, (place[1:] != place[:-1]) | ~inside[:-1] | (row[1:n] != row[: n - 1])]
    stop = inside & np.r_[(place[1:] != place[:-1]) | ~inside[1:] | (row[1:n] != row[: n - 1]), True]
    starts, ends = np.flatnonzero(first), np.flatnonzero(stop)
    whole = [text_names(names(data, 64, FACTORS[0], (raw, ANCHOR)), starts, ends + length), text_names(names(data, 64, FACTORS[1]), starts, ends + length)]
    return row[starts], starts, ends, name[place[starts]], place[starts], *whole


def _covering_max(least: np.ndarray, width: int, n: int) -> np.ndarray:
    """At each position the greatest of the minima of the windows that hold it (0 if none does)."""
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return sliding(padded, width, np.maximum)[:n]


def text_names(name: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A word of the names of byte ranges of 64 .. 192 bytes, from the 64-byte names: of the first, the next and the last 64 bytes, and the length."""
    with np.errstate(over="ignore"):
        size = ends - starts
        out = mix64(name[starts] + size.astype(np.uint64)) * np.uint64(0xD1342543DE82EF95)
        out = mix64(out + name[np.maximum(starts, np.minimum(starts + 64, ends - 64))])
        return mix64(out * np.uint64(0xA0761D6478BD642F) + name[ends - 64])


#: x, y: the pair; z, w: the name of the whole text; size: windows less one and, in the bits above 8, how far the first one
#: is before the anchor, or within the block's places (for REPEAT the bytes).
RANKED = "kind int, x long, y long, z long, w long, doc long, start int, size int"


def _batch(kind: int, x, y, z, w, doc, start, size) -> pa.RecordBatch:
    n = len(doc)
    longs = [pa.array(np.broadcast_to(np.asarray(v), n).astype(np.int64)) for v in (x, y, z, w, doc)]
    ints = [pa.array(np.broadcast_to(np.asarray(v), n).astype(np.int32)) for v in (start, size)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *longs, *ints], names=["kind", "x", "y", "z", "w", "doc", "start", "size"])


def _repeats(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Known repeats (in order of doc and start); they are dealt by document."""
    d, a, b = merged(doc, start, stop)
    return _batch(REPEAT, mix64(d.astype(np.uint64)), 0, 0, 0, d, a, b - a)


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching ranges of a document as one; ranges come in order of (doc, start)."""
    if not len(doc):
        return doc, start, stop
    far = np.int64(1) << 40
    base = np.cumsum(np.r_[0, (doc[1:] != doc[:-1]).astype(np.int64)]) * far
    reach = np.maximum.accumulate(stop + base)
    new = np.r_[True, start[1:] + base[1:] > reach[:-1]]
    lead = np.flatnonzero(new)
    last = np.r_[lead[1:], len(doc)] - 1
    return doc[lead], start[lead], reach[last] - base[lead]


class Seen:
    """The first place met of each of up to MOST_SEEN names; where there are more, those that came again stay."""

    def __init__(self) -> None:
        self.one = self.two = np.zeros(0, np.uint64)
        self.doc = self.start = self.hits = np.zeros(0, np.int64)

    def repeats(self, one: np.ndarray, two: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which rows (in order of doc and start) have a name that these or earlier rows have at an earlier place."""
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        again = np.zeros(len(one), bool)
        again[order[1:][(a[1:] == a[:-1]) & (b[1:] == b[:-1])]] = True
        lead = order[~again[order]]  # in the order of names
        if len(self.one):
            at = np.minimum(np.searchsorted(self.one, one[lead]), len(self.one) - 1)
            found = (self.one[at] == one[lead]) & (self.two[at] == two[lead])
            at, met = at[found], lead[found]
            self.hits[at] += 1
            later = (doc[met] > self.doc[at]) | ((doc[met] == self.doc[at]) & (start[met] > self.start[at]))
            again[met[later]] = True
            self.doc[at[~later]], self.start[at[~later]] = doc[met[~later]], start[met[~later]]
            lead = lead[~found]
        self._add(one[lead], two[lead], doc[lead], start[lead])
        return again

    def _add(self, one: np.ndarray, two: np.ndarray, doc: np.ndarray, start: np.ndarray) -> None:
        keep = slice(None)
        if len(self.one) + len(one) > MOST_SEEN:
            most = np.argsort(-self.hits, kind="stable")[: MOST_SEEN // 2]
            keep = np.sort(most[self.hits[most] > 0])
            one, two, doc, start = (v[: MOST_SEEN // 2] for v in (one, two, doc, start))
        old = [v[keep] for v in (self.one, self.two, self.doc, self.start, self.hits)]
        both = [np.concatenate(v) for v in zip(old, (one, two, doc, start, np.zeros(len(one), np.int64)), strict=True)]
        order = np.argsort(both[0], kind="stable")
        self.one, self.two, self.doc, self.start, self.hits = (v[order] for v in both)


def pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(start, bytes, offsets): the rows as they are, or a long one alone in pieces that have all its windows between them."""
    if len(offsets) > 2 or len(data) <= 2 * PIECE_BYTES:
        yield 0, data, offsets
        return
    for p in range(0, len(data) - length + 1, PIECE_BYTES):
        part = data[p : p + PIECE_BYTES + length - 1]
        yield p, part, np.array([0, len(part)])


def find_runs(texts: DataFrame, length: int) -> DataFrame:
    """Rows of doc and text to ranked rows: the runs of each piece, and the repeats that the task can tell."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(docs, kind="stable")
            column = text_column(batch.column(1)).take(pa.array(order))
            docs = docs[order]
            for i, own, at in slices(column, PIECE_BYTES):
                for shift, data, offsets in pieces(own, at, length):
                    row, start, last, anchor, place, one, two = runs(data, offsets, length)
                    if not len(row):
                        continue
                    doc, begin, stop = docs[i + row], start - offsets[row] + shift, last + length - offsets[row] + shift
                    again = seen.repeats(one, two, doc, begin)
                    size = (last - start) | (place - start) << 8
                    new = ~again
                    yield _batch(RUN, anchor[new], 0, one[new], two[new], doc[new], begin[new], size[new])
                    if again.any():
                        yield _repeats(doc[again], begin[again], stop[again])

    return texts.mapInArrow(find, RANKED)


def rank(rows: DataFrame, length: int, onward: bool = True) -> DataFrame:
    """Sort rows by their pair, whole text and place, and go through them in that order.

    All but the first row of a pair and text are repeats, and leave. Of the rest, those
    whose pair stands again go on, with its rank for x; what is unique leaves.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, waiting = np.int64(TaskContext.get().partitionId()) << 36, None, None
        for batch in batches:
            known = batch.column(0).to_numpy() == REPEAT
            if known.any():
                yield batch.filter(pa.array(known))
                batch = batch.filter(pa.array(~known))
            if not batch.num_rows:
                continue
            keys = {c: batch.column(c).to_numpy() for c in ("x", "y", "z", "w")}
            same = {c: np.r_[last is not None and v[0] == last[c], v[1:] == v[:-1]] for c, v in keys.items()}
            last = {c: v[-1] for c, v in keys.items()}
            pair = same["x"] & same["y"]
            again = pair & same["z"] & same["w"]
            if again.any():
                doc, start, size = (batch.column(c).to_numpy()[again] for c in ("doc", "start", "size"))
                yield _batch(REPEAT, mix64(doc.astype(np.uint64)), 0, 0, 0, doc, start, (size & 255) + length)
            lead = np.flatnonzero(~again)
            if not onward or not len(lead):
                continue
            further = pair[lead]
            ranks = number + np.cumsum(~further)
            number = ranks[-1]
            if waiting is not None and further[0]:  # the last of an earlier batch has a second here
                yield waiting
            waiting = None
            go = further | np.r_[further[1:], False]
            if go.any():
                yield ranked(batch, lead[go], ranks[go])
            if not go[-1]:  # the last may have a second in the next batch
                waiting = ranked(batch, lead[-1:], ranks[-1:])

    def ranked(batch: pa.RecordBatch, at: np.ndarray, ranks: np.ndarray) -> pa.RecordBatch:
        doc, start, size = (batch.column(c).to_numpy()[at] for c in ("doc", "start", "size"))
        return _batch(RUN, ranks, 0, 0, 0, doc, start, size)

    return rows.repartition("x", "y").sortWithinPartitions("x", "y", "z", "w", "doc", "start").mapInArrow(scan, RANKED)


def windows_of(ranges: DataFrame, texts: DataFrame, length: int, rows_of) -> DataFrame:
    """Ranked rows of the windows of ranges (doc, start, size, x); texts come to them by document.

    rows_of gets the names of 64 bytes and, for each window in order, its range, that one's x, how far the window is before the
    anchor (or, in a block, the block's last place), and its place in the bytes; it returns x, y, first and last window, and size of each row.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            docs, ranges = batch.column(0).to_numpy(), batch.column(2)
            for i, data, offsets in slices(text_column(batch.column(1)), PIECE_BYTES):
                own = ranges.slice(i, len(offsets) - 1)
                row = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy())
                start, size, x = (own.flatten().field(k).to_numpy().astype(np.int64) for k in range(3))
                order = np.lexsort((start, docs[i + row]))
                row, start, size, x = row[order], start[order], size[order], x[order]
                width = (size & 255) + 1
                of = np.repeat(np.arange(len(start)), width)
                step = np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width)
                at = start[of] + step
                left = (size >> 8)[of] - step
                for shift, part, _ in pieces(data, offsets, length):
                    mine = slice(None) if part is data else np.flatnonzero((at >= shift) & (at < shift + PIECE_BYTES))
                    if len(of[mine]):
                        yield from rows(seen, docs[i + row[of[mine]]], at[mine], of[mine], x[of[mine]], left[mine], part, offsets[row[of[mine]]] + at[mine] - shift)

    def rows(seen: Seen, doc, at, of, x, left, data, place) -> Iterator[pa.RecordBatch]:
        first, second = (names(data, 64, f) for f in FACTORS)
        x, y, low, high, size = rows_of(first, of, x, left, place)
        one, two = (text_names(name, place[low], place[high] + length) for name in (first, second))
        doc, start, stop = doc[low], at[low], at[high] + length
        again = seen.repeats(one, two, doc, start)
        new = ~again
        yield _batch(RUN, x[new], y[new], one[new], two[new], doc[new], start[new], size[new])
        if again.any():
            yield _repeats(doc[again], start[again], stop[again])

    wanted = ranges.groupBy("doc").agg(F.collect_list(F.struct("start", "size", "x")).alias("ranges"))
    return texts.hint("merge").join(wanted, "doc").sortWithinPartitions("doc").select("doc", "text", "ranges").mapInArrow(name, RANKED)


def block_rows(length: int):
    """Blocks of runs: (rank of the anchor and the block's place by it, name of what its windows share)."""

    def blocks(name: np.ndarray, of: np.ndarray, x: np.ndarray, left: np.ndarray, place: np.ndarray):
        group = left // BLOCK
        low = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (of[1:] != of[:-1])])
        high = np.r_[low[1:], len(of)] - 1
        common = place[low] + left[low] - group[low] * BLOCK  # of full blocks; those at a run's ends have fewer windows
        return x[low] << 4 | group[low], text_names(name, common, common + length - BLOCK + 1), low, high, (high - low) | (left[low] - group[low] * BLOCK) << 8

    return blocks


def window_rows():
    """Single windows of blocks: (rank of the block and the window's place in it, nothing)."""

    def windows(name: np.ndarray, of: np.ndarray, x: np.ndarray, left: np.ndarray, place: np.ndarray):
        each = np.arange(len(of))
        return x << 4 | left, np.zeros(len(of), np.int64), each, each, np.zeros(len(of), np.int64)

    return windows


def repeated_ranges(texts: DataFrame, length: int) -> tuple[DataFrame, list[str]]:
    """doc, start, size: ranges of bytes (they may overlap) that repeat earlier ones, of rows of doc and text; and the tables they are in."""
    runs_, a = materialize(rank(find_runs(texts, length), length), "ranked-runs", 4 * TEXT_ROWS)
    blocks = windows_of(runs_.where(F.col("kind") == RUN), texts, length, block_rows(length))
    blocks, b = materialize(rank(blocks, length), "ranked-blocks", 4 * TEXT_ROWS)
    windows = windows_of(blocks.where(F.col("kind") == RUN), texts, length, window_rows())
    windows, c = materialize(rank(windows, length, onward=False), "ranked-windows", 4 * TEXT_ROWS)
    known = [df.where(F.col("kind") == REPEAT).select("doc", "start", "size") for df in (runs_, blocks, windows)]
    return known[0].union(known[1]).union(known[2]), [a, b, c]


def without_repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs."""
    if not LEAST_LENGTH <= length <= MOST_LENGTH:
        raise ValueError(f"length must be from {LEAST_LENGTH} to {MOST_LENGTH}")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(text).alias("digest"), text.alias("text"))
    size = F.octet_length("text").cast("long")
    keys, keys_at = materialize(rows.select("doc_id", "digest", size.alias("n_bytes"), F.when(size < length, F.sha2("text", 256)).alias("short_sha")), "text-digests")
    odd = odd_ids(keys)
    # the first row of each digest: that of the least id, null before all others
    firsts = keys.where(F.col("n_bytes") >= length).groupBy("digest").agg(F.min("doc_id").alias("_least"), F.bool_or(F.col("doc_id").isNull()).alias("_null"))
    firsts = firsts.select("digest", F.when(~F.col("_null"), F.col("_least")).alias("first_id"))
    scratch = [keys_at]
    if odd:  # a number for each text, in the order of (id, digest)
        firsts, at = materialize(firsts.orderBy(F.asc_nulls_first("first_id"), "digest").withColumn("doc", F.monotonically_increasing_id()), "first-ids")
        scratch.append(at)
        keys = keys.groupBy("doc_id", "digest", "n_bytes", "short_sha").agg(F.count("*").alias("_n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).drop("_n")
    else:
        firsts, keys = firsts.withColumn("doc", F.col("first_id")), keys.withColumn("copy", F.lit(1))
    firsts = firsts.withColumnRenamed("digest", "_digest")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("_digest"))
    texts = rows.where(F.octet_length("text") >= length).join(firsts, is_first).select("doc", "text")
    texts, texts_at = materialize(texts.dropDuplicates(["doc"]) if odd else texts, "first-texts")
    ranges, ranges_at = repeated_ranges(texts, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, sums = [], [], []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                pairs = np.array([(r["start"], r["start"] + r["size"]) for r in found or []], np.int64).reshape(-1, 2)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                _, a, b = merged(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
                removed.append(int((b - a).sum()))
                spans.append(len(a))
                digest, at = hashlib.sha256(), 0
                for s, e in zip(a.tolist(), b.tolist(), strict=True):
                    digest.update(data[at:s])
                    at = e
                digest.update(data[at:])
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sums)], names=["doc", "n_removed", "n_spans", "kept_sha256"])

    by_doc = ranges.groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias("ranges"))
    done = texts.join(by_doc, "doc", "left").select("doc", "text", "ranges").mapInArrow(cut, "doc long, n_removed long, n_spans long, kept_sha256 string")
    done, done_at = materialize(done, "cut-texts", TEXT_ROWS)
    remove(spark, texts_at, *ranges_at)
    # rows find their text's result by id and digest, so the copies of one text aren't all in one task
    done, found_at = materialize(done.join(firsts, "doc").drop("doc"), "cut-ids")
    short, first = F.col("short_sha").isNotNull(), F.col("kept_sha256").isNotNull() & (F.col("copy") == 1)
    out = keys.join(done, is_first, "left").select(
        "doc_id",
        "n_bytes",
        F.when(short, 0).when(first, F.col("n_removed")).otherwise(F.col("n_bytes")).cast("long").alias("n_removed"),
        F.when(short, 0).when(first, F.col("n_spans")).otherwise(1).cast("long").alias("n_spans"),
        F.when(short, F.col("short_sha")).when(first, F.col("kept_sha256")).otherwise(F.sha2(F.lit(""), 256)).alias("kept_sha256"),
    )
    result, _ = materialize(out, "substrings")
    remove(spark, done_at, found_at, *scratch)
    return result


def odd_ids(keys: DataFrame) -> bool:
    """Whether an id is null or stands more than once."""
    return not keys.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty()
