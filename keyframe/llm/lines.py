"""Line dedup: an exact set-similarity join of lines.

A line (between line feeds) is the set of its words (between ASCII white space). Two
lines match if the Jaccard similarity of their sets is at least `threshold`. A line is
removed if a line that stands earlier in the input - in a document of smaller id, or
above it - matches it, whether or not that one stays.

Join: words are ordered by rarity (in how many different lines they stand, counted in a
hashed table of fixed size; ties by hash). Matching sets share one of their rarest words, so each set
is listed under its prefix of n - ceil(t n) + 1 words only. Under a word, pairs pass a
length filter, a positional filter (what can still overlap from here) and a parity
filter (each word flips one of 128 bits; sets that differ in d words differ in at most d
bits). No filter loses a match. Listings are shuffled as lists: words are dealt into buckets,
as many as keep a bucket small, and a task sends the listings of a bucket as one row of
columns. The pairs that pass aren't written out, as thousands of
variants of a line would make millions: a task only passes on the listings that have a
pair. Those get their full sets; under each word their pairs are verified exactly, each
pair where its first common word is, and a set's number of matches and the earliest line
among them are returned.

Equal sets are one; in-task repeats are dropped before the shuffle, so a line that a
third of all documents hold is listed about once per task. Sets too small to match any but
equal ones (at 0.8 those of one to three words) aren't listed. A word under which more than
`BLOCK_ROWS` sets are listed - a template line of many variants makes one - is split: its
sets are dealt into blocks, and each pair of blocks is a task's work of bounded size. Such
words are counted first, and at most `MOST_HOT` of them are split, the most frequent ones.

Words are compared by 32 bits of their hashes, so a pair of lines whose similarity is within
one word of the threshold may be judged wrongly if two of their words collide: for two
lines of 20 words that is once in ten million such pairs. Equal lines go by 64 bits.

Defined results: a null text is empty; a line without words is never removed; a null id
stands before all others; rows of one id are one document's copies (their equal lines
both stay); a document that loses all lines stays, with an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, WORD_GAP, free_name, giving_back, materialize, mix64, remove, slices, span_hashes, text_column, whole_groups, word_spans

THRESHOLD = 0.8
BUCKETS = 1 << 20
BLOCK = 1 << 12
#: Sets under one word that are compared at a time, and words that are split if they have more.
BLOCK_ROWS = 1 << 14
MOST_HOT = 1 << 20
#: Sets that a task remembers to have listed.
MOST_SEEN = 1 << 18
#: Pairs that are verified at a time.
PAIRS = 4096
#: Listings that a task holds before it deals them into buckets, and the number that a bucket gets on a large table.
HELD = 1 << 18
BUCKET_ROWS = 1 << 17


def least_size(threshold: float) -> int:
    """The size of the smallest sets that can match another: n of n + 1 words must reach the threshold."""
    n = 1
    while n < threshold * (n + 1) - 1e-9:
        n += 1
    return n


def line_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each line with words, and one for a document without: doc_id, n_lines, line, set_key, n, tokens.

    tokens (32 bits each) stand at a set's first lines in a task only: once for each slice of one batch of rows, or more often where a
    task has very many different sets.
    """
    feed = np.uint8(10)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, fresh = np.zeros(0, np.uint64), []
        for batch in batches:
            seen = np.unique(np.concatenate([seen if len(seen) < MOST_SEEN else seen[:0], *fresh]))
            fresh = []
            for first, data, offsets in slices(text_column(batch.column(1))):
                n_rows = len(offsets) - 1
                feeds = np.flatnonzero(data == feed)
                before = np.searchsorted(feeds, offsets)
                starts, ends, row = word_spans(data, offsets, WORD_GAP)
                h = span_hashes(data, starts, ends)
                above = np.repeat(np.arange(len(feeds) + 1), np.diff(np.r_[0, np.searchsorted(starts, feeds), len(starts)]))
                line = above + row  # rises by one at each line feed and each row
                number, row_of, line_no = _lines(line, row, above - before[row])
                keys, sizes, tokens = _sets(h, number, len(row_of))
                new, lead = np.unique(keys, return_index=True)
                known = seen[np.minimum(np.searchsorted(seen, new), len(seen) - 1)] == new if len(seen) else np.zeros(len(new), bool)
                leads = np.zeros(len(keys), bool)
                leads[lead[~known]] = True
                fresh.append(new[~known])
                bare = np.setdiff1d(np.arange(n_rows), row_of)
                at = np.concatenate([row_of, bare])
                n_lines = (np.diff(before) + 1)[at]
                without, zeros = np.arange(len(at)) >= len(row_of), np.zeros(len(bare), np.int64)
                own = np.concatenate([leads, zeros > 0])
                bounds = np.r_[0, np.cumsum(np.concatenate([np.where(leads, sizes, 0), zeros]))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n_rows).take(pa.array(at)),
                        pa.array(n_lines, pa.int32()),
                        pa.array(np.concatenate([line_no, zeros]), pa.int32()),
                        pa.array(np.concatenate([keys.view(np.int64), zeros]), pa.int64(), mask=without),
                        pa.array(np.concatenate([sizes, zeros]), pa.int32()),
                        binaries(tokens[np.repeat(leads, sizes)], bounds, own),
                    ],
                    names=["doc_id", "n_lines", "line", "set_key", "n", "tokens"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(giving_back(sets), "doc_id long, n_lines int, line int, set_key long, n int, tokens binary")


def binaries(values: np.ndarray, bounds: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A binary value for each run of values between bounds; null where it isn't valid."""
    ends, present = pa.py_buffer((bounds * values.itemsize).astype(np.int64)), None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [present, ends, pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def unpacked(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """The values in a binary column without nulls, one row's after the other's."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(data, kind, int(ends[-1] - ends[0]) // np.dtype(kind).itemsize, int(ends[0]))


def word_classes(sets: DataFrame) -> np.ndarray:
    """Rarity class (0 rarest .. 63) of each bucket of tokens, from their counts over all stored sets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            if batch.num_rows:
                flat = unpacked(batch.column(0), np.uint32)
                total += np.bincount(flat & np.uint32(BUCKETS - 1), minlength=BUCKETS)
        parts = total.astype(np.uint32).reshape(-1, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([np.minimum(63, np.log2(1 + v) * 2).astype(np.uint8).tobytes() for v in sums.values()], pa.binary())], names=["block", "classes"])

    parts = sets.where("tokens IS NOT NULL").select("tokens").mapInArrow(giving_back(count), "block int, counts binary").repartition("block").mapInArrow(add, "block int, classes binary")
    classes = np.zeros(BUCKETS, np.uint8)
    for r in parts.toLocalIterator():  # BUCKETS bytes in all
        classes[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["classes"], np.uint8)
    return classes


def by_rarity(flat: np.ndarray, sizes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The tokens of sets (one after the other), each set's in order of class and value."""
    key = np.repeat(np.arange(len(sizes), dtype=np.uint64) << np.uint64(38), sizes)
    key |= classes[flat & np.uint32(BUCKETS - 1)].astype(np.uint64) << np.uint64(32)
    key |= flat
    key.sort()
    return key.astype(np.uint32)


def _lines(line: np.ndarray, row: np.ndarray, line_no: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words to consecutive line numbers; each line's row and number in its text."""
    if not len(line):
        return line, row, line_no
    new = np.r_[True, line[1:] != line[:-1]]
    return np.cumsum(new) - 1, row[new], line_no[new]


def _sets(h: np.ndarray, number: np.ndarray, n_lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key and size of each line's set, and all sets' tokens one after the other."""
    keys, sizes, tokens = np.zeros(n_lines, np.uint64), np.zeros(n_lines, np.int64), [np.zeros(0, np.uint32)]
    for base in range(0, n_lines, 1 << 12):  # 12 bits of a sort key are the line
        a, b = np.searchsorted(number, [base, base + (1 << 12)])
        key = ((number[a:b] - base).astype(np.uint64) << np.uint64(52)) | (h[a:b] >> np.uint64(12))
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]]
        of = (key >> np.uint64(52)).astype(np.int64) + base
        token = key & np.uint64((1 << 52) - 1)
        leads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        keys[of[leads]] = mix64(np.add.reduceat(mix64(token + np.uint64(1)), leads))
        sizes[of[leads]] = np.diff(np.r_[leads, len(of)])
        tokens.append(token.astype(np.uint32))
    return keys, sizes, np.concatenate(tokens)


def parities(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, in two words, one of which each token flips (by seven bits of it that its bucket has no part in)."""
    place = flat >> np.uint32(25)
    bit = np.uint64(1) << (place & np.uint32(63)).astype(np.uint64)
    low = place < 64
    return np.bitwise_xor.reduceat(np.where(low, bit, np.uint64(0)), starts), np.bitwise_xor.reduceat(np.where(low, np.uint64(0), bit), starts)


def prefix_lengths(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many words sets of n tokens are listed under."""
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def prefix_words(n: np.ndarray, flat: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set, place and token of each prefix word of sets of n tokens, which come one after the other in order of rarity."""
    length = prefix_lengths(n, threshold)
    row = np.repeat(np.arange(len(n)), length)
    place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    return row, place, flat[(np.cumsum(n) - n)[row] + place]


def listed_sets(sets: DataFrame, threshold: float) -> DataFrame:
    return sets.where(F.col("tokens").isNotNull() & (F.col("n") >= least_size(threshold))).select("set_key", "n", "tokens")


def stored_tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and tokens of rows of set_key, n and tokens."""
    return batch.column(1).to_numpy().astype(np.int64), unpacked(batch.column(2), np.uint32)


def hot_words(sets: DataFrame, classes, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (sorted) under which over BLOCK_ROWS sets are listed, and into how many blocks their sets are dealt."""
    least = int(2 * np.log2(1 + BLOCK_ROWS))  # a word listed so often stands in so many sets, and its bucket is of this class
    if classes.value.max() < least:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, flat = stored_tokens(batch)
            often = classes.value[flat & np.uint32(BUCKETS - 1)] >= least
            some = np.add.reduceat(~often, np.cumsum(n) - n, dtype=np.int64) < prefix_lengths(n, threshold)  # other sets have rarer words enough
            if some.any():
                token = prefix_words(n[some], by_rarity(flat[np.repeat(some, n)], n[some], classes.value), threshold)[2]
                token = token[classes.value[token & np.uint32(BUCKETS - 1)] >= least]
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int32))], names=["token"])

    counts = listed_sets(sets, threshold).mapInArrow(giving_back(words), "token int").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS)
    found = counts.orderBy(F.desc("n"), "token").limit(MOST_HOT).toArrow()
    token, n = found.column("token").to_numpy().view(np.uint32), found.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], -(-n[order] // BLOCK_ROWS)


def blocks_of(token: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Into how many blocks the sets under each token are dealt."""
    if not len(hot[0]):
        return np.ones(len(token), np.int64)
    at = np.minimum(np.searchsorted(hot[0], token), len(hot[0]) - 1)
    return np.where(hot[0][at] == token, hot[1][at], 1)


def block_of(key: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return (mix64(key.view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)


#: token, part, size (n, and the word's place below it), set_key, low and high (parities): a listing.
LISTING = {"token": np.int32, "part": np.int64, "size": np.int64, "set_key": np.int64, "low": np.int64, "high": np.int64}
FOUND = "token int, part long, size long, set_key long"


def n_buckets(sets: DataFrame, threshold: float) -> int:
    """Into how many buckets words are dealt: a power of two, by the number of listings that lines make, repeated ones included."""
    n = F.col("n")
    total = sets.where(n >= least_size(threshold)).agg(F.sum(n - F.ceil(n * threshold - 1e-9) + 1)).first()[0] or 1
    most = max(total // BUCKET_ROWS, min(total // (BUCKET_ROWS >> 5), 1 << 10), 1)
    return 1 << (int(most) - 1).bit_length()


def dealt(columns: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """A row for each bucket that listings (columns as in LISTING) fall into."""
    bucket = mix64(columns[0].view(np.uint32).astype(np.uint64) | columns[1].astype(np.uint64) << np.uint64(32)) & np.uint64(buckets - 1)
    key = bucket << np.uint64(32) | np.arange(len(bucket), dtype=np.uint64)
    key.sort()
    bucket, order = (key >> np.uint64(32)).astype(np.int32), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    bounds = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    return pa.RecordBatch.from_arrays([pa.array(bucket[bounds[:-1]]), *(binaries(c[order], bounds) for c in columns)], names=["bucket", *LISTING])


def prefix_lists(sets: DataFrame, classes, hot, buckets: int, threshold: float) -> DataFrame:
    """bucket, and the columns of LISTING as binary: a listing for each prefix word of each listed set, and under a split word for each pair of
    blocks that the set is in. classes, hot: broadcast."""

    def entries(batch: pa.RecordBatch) -> list[np.ndarray]:
        n, flat = stored_tokens(batch)
        flat = by_rarity(flat, n, classes.value)
        low, high = parities(flat, np.cumsum(n) - n)
        row, place, token = prefix_words(n, flat, threshold)
        key = batch.column(0).to_numpy()[row]
        blocks = blocks_of(token, hot.value)
        own = block_of(key, blocks)
        each = np.repeat(np.arange(len(row)), blocks)
        other = np.arange(len(each)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        part = np.minimum(own[each], other) * blocks[each] + np.maximum(own[each], other)
        return [token.view(np.int32)[each], part, (n[row] << 32 | place)[each], key[each], *(x[row].view(np.int64)[each] for x in (low, high))]

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(entries(batch))
                n += len(held[-1][0])
            if n >= HELD:
                yield dealt([np.concatenate(c) for c in zip(*held, strict=True)], buckets)
                held, n = [], 0
        if n:
            yield dealt([np.concatenate(c) for c in zip(*held, strict=True)], buckets)

    return listed_sets(sets, threshold).mapInArrow(giving_back(lists), "bucket int, " + ", ".join(f"{c} binary" for c in LISTING))


def sides(token: np.ndarray, part: np.ndarray, key: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The block of each listing in a part of two blocks, of which only pairs across count; -1 elsewhere."""
    blocks = blocks_of(token.view(np.uint32), hot)
    return np.where(part // blocks == part % blocks, -1, block_of(key, blocks))


def passing_pairs(group: np.ndarray, size: np.ndarray, parity: tuple[np.ndarray, np.ndarray], side: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (k, j) of pairs of one group that pass the filters; entries come in the order of (group, size)."""
    share, apart = threshold / (1 + threshold), (1 - threshold) / (1 + threshold)
    n, rest = (size >> 32).astype(np.int32), ((size >> 32) - (size & 0xFFFFFFFF)).astype(np.int32)
    # the smaller set (n rises within a group) must be able to reach the overlap with one of its own size
    k = np.flatnonzero((group[:-1] == group[1:]) & (rest[:-1] >= 2 * share * n[:-1] - 1e-6))
    step = 1
    while len(k):
        j = k + step
        k, j = (k, j) if j[-1] < len(group) else (k[j < len(group)], j[j < len(group)])
        near = (group[k] == group[j]) & (n[k] >= threshold * n[j] - 1e-6)  # what fails now fails from here on
        k, j = k[near], j[near]
        both = n[k] + n[j]
        ok = np.flatnonzero((np.minimum(rest[k], rest[j]) >= share * both - 1e-6) & ((side[k] < 0) | (side[k] != side[j])))
        for bits in ((0,), (0, 1)):  # most pairs fail by half of them already
            differ = sum(np.bitwise_count(parity[i][k[ok]] ^ parity[i][j[ok]]).astype(np.int32) for i in bits)
            ok = ok[differ <= apart * both[ok] + 1e-6]
        if len(ok):
            yield k[ok], j[ok]
        step += 1


def listings_with_pairs(lists: DataFrame, hot, threshold: float) -> DataFrame:
    """The listings (token, part, size, set_key), each once, that pass the filters with another set under their word."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = [unpacked(table.column(c), kind) for c, kind in LISTING.items()]
        token, part, size, key = columns[:4]
        order = np.lexsort((key, size, part, token) if part.any() else (key, token.astype(np.int64) << 32 | size >> 32))
        token, part, key = token[order], part[order], key[order]
        new = np.r_[True, (token[1:] != token[:-1]) | (part[1:] != part[:-1])]
        once = new | np.r_[True, key[1:] != key[:-1]]  # several tasks list the sets that they share
        group = np.cumsum(new)[once]
        token, part, size, key, low, high = token[once], part[once], *(c[order[once]] for c in columns[2:])
        held = np.zeros(len(token), bool)
        for k, j in passing_pairs(group, size, (low.view(np.uint64), high.view(np.uint64)), sides(token, part, key, hot.value), threshold):
            differ = key[k] != key[j]  # two words of a set can have one token
            held[k[differ]] = held[j[differ]] = True
        if held.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[held]) for c in (token, part, size, key)], names=list(LISTING)[:4])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket"], 1):
            bucket = table.column("bucket").to_numpy()
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            before = np.r_[0, np.cumsum(pc.binary_length(table.column("token")).to_numpy())][first] // (4 * BUCKET_ROWS)
            cuts = [*first[np.r_[True, before[1:] != before[:-1]]].tolist(), len(bucket)]  # buckets together as long as they are small
            for a, b in pairwise(cuts):
                yield from work(table.slice(a, b - a))

    return lists.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(giving_back(scan), FOUND)


def by_word(rows: DataFrame, work, schema: str) -> DataFrame:
    """rows dealt by token and part; work gets tables of whole groups, with the number of each row's group, in the order of (group, size)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["token", "part"]):
            token, part = table.column("token").to_numpy(), table.column("part").to_numpy()
            group = np.cumsum(np.r_[False, (token[1:] != token[:-1]) | (part[1:] != part[:-1])])
            yield from work(table, group)

    return rows.repartition("token", "part").sortWithinPartitions("token", "part", "size").mapInArrow(giving_back(scan), schema)


def in_chunks(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, PAIRS at a time."""
    held, n = [], 0
    for pair in pairs:
        held.append(pair)
        n += len(pair[0])
        if n >= PAIRS:
            k, j = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = n - n % PAIRS
            yield from ((k[i : i + PAIRS], j[i : i + PAIRS]) for i in range(0, whole, PAIRS))
            held, n = [(k[whole:], j[whole:])], n - whole
    if n:
        k, j = (np.concatenate(x) for x in zip(*held, strict=True))
        yield k, j


def verified(flat: np.ndarray, sizes: np.ndarray, place: np.ndarray, k: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (k, j) of sets match and have no word in common before k's `place`; flat: the sets' tokens, as 64 bits."""
    starts = np.cumsum(sizes) - sizes

    def keys(side: np.ndarray, n: np.ndarray) -> np.ndarray:
        """pair and token, of the first n tokens of each set."""
        at = np.arange(int(n.sum())) + np.repeat(starts[side] - (np.cumsum(n) - n), n)
        return np.repeat(np.arange(len(side), dtype=np.uint64) << np.uint64(32), n) | flat[at]

    def shared(k: np.ndarray, j: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Tokens in common of each pair, of the first n and m."""
        both = np.concatenate([keys(k, n), keys(j, m)])
        both.sort()
        return np.bincount((both[:-1][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(k))

    # a common word before this one stands before it in both, as the order is one for all
    ok = shared(k, j, place[k], place[j]) == 0
    k, j = k[ok], j[ok]
    common = shared(k, j, sizes[k], sizes[j])
    ok[ok] = common >= threshold * (sizes[k] + sizes[j] - common) - 1e-9
    return ok


def with_order(sets: DataFrame, classes) -> DataFrame:
    """sets (set_key, n, tokens, doc_id, line) with their tokens in the order of rarity, and low and high (parities)."""

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, flat = stored_tokens(batch)
                flat = by_rarity(flat, n, classes.value)
                bounds = np.r_[0, np.cumsum(n)]
                parity = (pa.array(x.view(np.int64)) for x in parities(flat, bounds[:-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0), binaries(flat, bounds), batch.column(3), batch.column(4), *parity], names=["set_key", "tokens", "doc_id", "line", "low", "high"])

    return sets.mapInArrow(giving_back(order), "set_key long, tokens binary, doc_id long, line int, low long, high long")


def matching_sets(sets: DataFrame, firsts: DataFrame, threshold: float) -> tuple[DataFrame, list[str]]:
    """set_key, n_links, there: how many other sets match each set, and the earliest line (doc_id, line) of those; sets without any aren't listed. And the tables behind it."""
    spark = sets.sparkSession.sparkContext
    classes = spark.broadcast(word_classes(sets))
    hot = spark.broadcast(hot_words(sets, classes, threshold))
    lists = prefix_lists(sets, classes, hot, n_buckets(sets, threshold), threshold)
    listed, a = materialize(listings_with_pairs(lists, hot, threshold), "line-listings", TEXT_ROWS)
    involved = listed.select("set_key").distinct()
    full = sets.where("tokens IS NOT NULL").select("set_key", "n", "tokens").hint("merge").join(involved, "set_key").groupBy("set_key").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    least = -(1 << 63)  # stands for a null id
    full = full.join(firsts, "set_key").select("set_key", "n", "tokens", F.coalesce("first.doc_id", F.lit(least)).alias("doc_id"), "first.line")
    full, b = materialize(with_order(full, classes), "line-tokens")
    rows = listed.join(full.hint("merge"), "set_key").select("token", "part", "size", "set_key", "low", "high", "tokens", "doc_id", "line")

    def work(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        token, part, size, key, doc, line = (table.column(c).to_numpy() for c in ("token", "part", "size", "set_key", "doc_id", "line"))
        parity = tuple(table.column(c).to_numpy().view(np.uint64) for c in ("low", "high"))
        sizes, place = size >> 32, size & 0xFFFFFFFF
        flat = unpacked(table.column("tokens"), np.uint32).astype(np.uint64)
        order = np.lexsort((line, doc))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        n_links, best = np.zeros(len(key), np.int64), np.full(len(key), len(key), np.int64)
        for k, j in in_chunks(passing_pairs(group, size, parity, sides(token, part, key, hot.value), threshold)):
            differ = key[k] != key[j]
            k, j = k[differ], j[differ]
            ok = verified(flat, sizes, place, k, j, threshold)
            k, j = k[ok], j[ok]
            np.add.at(n_links, k, 1)
            np.add.at(n_links, j, 1)
            np.minimum.at(best, k, rank[j])
            np.minimum.at(best, j, rank[k])
        at = np.flatnonzero(n_links)
        if len(at):
            there = order[best[at]]
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(n_links[at]), pa.array(doc[there]), pa.array(line[there])], names=["set_key", "n_links", "doc_id", "line"])

    found = by_word(rows, work, "set_key long, n_links long, doc_id long, line int")
    there = F.struct(F.when(F.col("doc_id") != least, F.col("doc_id")).alias("doc_id"), "line")
    links, c = materialize(found.groupBy("set_key").agg(F.sum("n_links").alias("n_links"), F.min(there).alias("there")), "line-links", 4 * TEXT_ROWS)
    return links, [a, b, c]


def match_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, list[str]]:
    """A row for each line with words (and one for a document without): doc_id, n_lines, line, n_links, earliest (the earliest
    line that matches, itself if none does). And the tables behind it."""
    sets, a = materialize(line_sets(docs, id_col, text_col), "line-sets", TEXT_ROWS)
    firsts = sets.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n_rows"))
    firsts, b = materialize(firsts, "line-firsts")
    linked, scratch = matching_sets(sets, firsts, threshold)
    # least() skips nulls, and a null id is smaller than any other within the struct; written, so that Spark can split a frequent line in the join
    earliest = firsts.join(linked, "set_key", "left").where("n_rows > 1 OR n_links IS NOT NULL")
    earliest, c = materialize(earliest.select("set_key", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.least("first", "there").alias("earliest")), "line-earliest")
    rows = sets.select("doc_id", "n_lines", "line", "set_key").join(earliest, "set_key", "left")
    own = F.struct("doc_id", "line")
    return rows.select("doc_id", "n_lines", "line", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("earliest", own).alias("earliest")), [a, b, c, *scratch]


def line_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: doc_id, class_id (of the earliest document that one of its lines matches), n_links, n_lines, n_removed, removed_lines."""
    rows, scratch = match_lines(docs, id_col, text_col, threshold)
    later = F.struct("doc_id", "line") > F.col("earliest")
    found = rows.groupBy("doc_id").agg(
        F.min("earliest.doc_id").alias("class_id"),
        F.sum("n_links").alias("n_links"),
        F.max("n_lines").alias("n_lines"),
        F.count_if(later).alias("n_removed"),
        F.sort_array(F.collect_set(F.when(later, F.col("line")))).alias("removed_lines"),
    )
    result, _ = materialize(found, "line-duplicates")
    remove(docs.sparkSession, *scratch)
    return result


def without_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with their later matching lines removed; length_col, if given, is set to the new length."""
    key, lines = free_name("_line_id", docs), free_name("_gone", docs)
    gone = line_duplicates(docs, id_col, text_col, threshold).where("n_removed > 0").select(F.col("doc_id").alias(key), F.col("removed_lines").alias(lines))
    rows = docs.join(gone.hint("merge"), F.col(id_col).eqNullSafe(F.col(key)), "left")  # the same plan at every size
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains(lines, i))
    changed = F.col(lines).isNotNull()
    text = F.when(changed, F.array_join(kept, "\n")).otherwise(F.col(text_col))
    length = F.when(changed, F.length(text)).otherwise(F.col(length_col)) if length_col else None
    return rows.select(*(text.alias(c) if c == text_col else length.alias(c) if c == length_col else F.col(c) for c in docs.columns))
