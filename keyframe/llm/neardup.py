"""Near duplicates by ProbMinHash.

A text is a weighted set: its runs of five words (split at ASCII white space), each
weighted by how often it stands. A shingle of weight w sends arrivals at rate w, each
to one of the signature's slots; a slot keeps its earliest arrival. A shingle is
dropped as soon as its next arrival is later than all slots, so few arrivals are drawn
beyond the first. Equal slots estimate the probability Jaccard similarity
J_P = sum over common d of 1 / sum over i of max(x_i / x_d, y_i / y_d), which is the
plain Jaccard similarity for sets. Bands of slots propose pairs; a pair is a link if its
exact J_P reaches the threshold.

Equal texts are one node. Pairs are proposed in rounds, so that a bucket of n texts
doesn't make n squared: first each text with the most central text of its buckets (that
which shares most slots with others), then with its buckets' other leads while the ends
are in different classes, then, without a cap, all pairs of a bucket whose ends are in
different classes even then and whose estimate comes near the threshold. A bucket of more
than `BLOCK` texts is cut into blocks, and its pairs of blocks are dealt over the tasks:
what is compared is signatures, in arrays of bounded size. Pairs within a class can't
change it, and aren't verified. Classes are the connected components; each round joins
those of the round before. Tables between the steps are written to the shared folder.

Defined results: a null text is empty; equal texts, empty ones too, are always of one
class; a text without a word is linked to no other text; one of fewer than five words is
one shingle of all of them; a class is named by its smallest id, which is null if all are;
rows are documents of their own, whatever their ids; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXT_ROWS, free_name, giving_back, materialize, mix64, remove, shingles, slices, text_column, whole_groups

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6
#: Slots of a signature; the first BANDS * ROWS make the bands, 4 bits of each are kept for estimates.
SLOTS = 512
#: An estimate's deviation at 0.8 is 0.0185; a pair four deviations below isn't verified.
LEAST_ESTIMATE = THRESHOLD - 4 * 0.0185
#: Texts of a bucket that are held at a time.
BLOCK = 1024
#: Pairs of signatures that are compared at a time.
PAIRS = 1 << 12
#: Arrivals that are drawn at a time.
ARRIVALS = 1 << 14
#: Edges for each file of labels, and files at least.
EDGE_ROWS, LEAST_FILES = 1 << 14, 8
MOST_UNEQUAL = int(SLOTS * (1 - (1 / 16 + LEAST_ESTIMATE * 15 / 16)))


def weighted(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (hash, row) pairs and how often each stands."""
    with np.errstate(over="ignore"):
        key = h ^ mix64(row.astype(np.uint64) + np.uint64(1))
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return h[first], row[first], count


def prob_min_hash(h: np.ndarray, row: np.ndarray, weight: np.ndarray, n_rows: int, slots: int) -> np.ndarray:
    """The shingle that each slot of each row keeps: n_rows x slots (0 in a row without shingles).

    A row of few shingles takes thousands of arrivals of each: the fewer shingles still draw, the more arrivals of
    each are drawn at once.
    """
    early = np.full(n_rows * slots, np.inf)
    kept = np.zeros(n_rows * slots, np.uint64)
    latest = np.full(n_rows, np.inf)
    weight, time, step = weight.astype(np.float64), np.zeros(len(h)), 0
    with np.errstate(over="ignore"):
        while len(h):
            k = max(1, min(ARRIVALS // len(h), 1 + step // 3))
            steps = mix64(np.arange(step + 1, step + k + 1, dtype=np.uint64))
            step += k
            for i in range(0, len(h), ARRIVALS):
                own, of_row = h[i : i + ARRIVALS], row[i : i + ARRIVALS]
                draw = mix64(own[:, None] ^ steps)
                times = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0) / weight[i : i + ARRIVALS, None]
                times[:, 0] += time[i : i + ARRIVALS]
                np.cumsum(times, axis=1, out=times)
                time[i : i + ARRIVALS] = times[:, -1]
                due = np.flatnonzero(times <= latest[of_row][:, None])
                of, at = due // k, times.ravel()[due]
                place = of_row[of] * slots + (mix64(draw.ravel()[due]) % np.uint64(slots)).astype(np.int64)
                np.minimum.at(early, place, at)
                won = np.flatnonzero(early[place] == at)
                kept[place[won]] = own[of[won]]
            latest = early.reshape(n_rows, slots).max(1)
            stay = np.flatnonzero(time <= latest[row])
            h, row, weight, time = h[stay], row[stay], weight[stay], time[stay]
    return kept.reshape(n_rows, slots)


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, digest, whether there is a word, bands and packed signature of every row."""
    salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in slices(text_column(batch.column(2))):
                n = len(offsets) - 1
                h, row, count = weighted(*shingles(data, offsets, WORDS))
                kept = prob_min_hash(h, row, count, n, SLOTS)
                some = np.bincount(row, minlength=n) > 0
                with np.errstate(over="ignore"):
                    bands = np.zeros((n, BANDS), np.uint64) + salt
                    for r in range(ROWS):
                        bands = mix64(bands * np.uint64(0x100000001B3) + kept[:, r : BANDS * ROWS : ROWS])
                low = (kept & np.uint64(15)).astype(np.uint8)
                packed = (low[:, ::2] | low[:, 1::2] << 4).view(np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.astype(np.int64).ravel())) for x in (bands, packed)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, n) for k in (0, 1)), pa.array(some), *lists], names=["id", "digest", "worded", "bands", "signature"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"))
    return rows.mapInArrow(giving_back(sign), "id long, digest binary, worded boolean, bands array<long>, signature array<long>")


def likely(a: str, b: str):
    """Whether the signatures in columns a and b differ in few enough of their 4-bit slots."""
    unequal = []
    for i in range(SLOTS // 16):
        differ = f"({a}[{i}] ^ {b}[{i}])"
        pairs = f"({differ} | shiftrightunsigned({differ}, 1))"
        unequal.append(f"bit_count(({pairs} | shiftrightunsigned({pairs}, 2)) & 1229782938247303441L)")
    return F.expr(f"{' + '.join(unequal)} <= {MOST_UNEQUAL}")


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """J_P of two weighted sets: sorted different hashes a, b with counts x, y."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = b[at] == a if len(b) else np.zeros(len(a), bool)
    if not common.any():
        return 0.0
    if (x == 1).all() and (y == 1).all():
        n = int(common.sum())
        return n / (len(a) + len(b) - n)
    x, y = x.astype(np.float64), y.astype(np.float64)
    cx, cy = x[common], y[at[common]]
    ratio = cy / cx
    order = np.argsort(ratio)
    ratio, cx, cy = ratio[order], cx[order], cy[order]
    below = x.sum() - cx.sum() + np.concatenate(([0.0], np.cumsum(cx)))  # only in x: ratio 0, always below
    above = y.sum() - np.concatenate(([0.0], np.cumsum(cy)))
    k = np.searchsorted(ratio, ratio, "left")
    return float((1.0 / (below[k] / cx + above[k] / cy)).sum())


@F.arrow_udf(T.DoubleType())
def similarity(a: pa.Array, x: pa.Array, b: pa.Array, y: pa.Array) -> pa.Array:
    """J_P of stored sets."""
    get = lambda v, t: np.frombuffer(v.as_buffer(), t)
    return pa.array([probability_jaccard(get(p, np.uint64), get(q, np.uint32), get(r, np.uint64), get(s, np.uint32)) for p, q, r, s in zip(a, x, b, y, strict=True)], pa.float64())


def shingle_sets(texts: DataFrame) -> DataFrame:
    """uid, hashes (sorted) and counts of rows of uid and text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in slices(text_column(batch.column(1))):
                n = len(offsets) - 1
                h, row, count = weighted(*shingles(data, offsets, WORDS))
                order = np.lexsort((h, row))
                h, row, count = h[order], row[order], count[order].astype(np.uint32)
                at = np.searchsorted(row, np.arange(n + 1))
                cut = lambda v: pa.array([v[at[i] : at[i + 1]].tobytes() for i in range(n)], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), cut(h), cut(count)], names=["uid", "hashes", "counts"])

    return texts.mapInArrow(giving_back(sets), "uid long, hashes binary, counts binary")


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """node, label (the smallest node it is joined to) of all nodes of edges (a, b); and where they are written."""
    spark = edges.sparkSession
    both, path = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    files = max(LEAST_FILES, -(-both.count() // EDGE_ROWS))  # not one for each shuffle partition: each round writes them anew
    labels, kept = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node").coalesce(files), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b").withColumnRenamed("label", "there"), "b").groupBy("a").agg(F.min("there").alias("there"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("there", "label")).alias("label"))
        onward = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        moved, new = materialize(step.join(onward, "label", "left").select("node", "was", F.least("label", F.coalesce("jump", "label")).alias("label")).coalesce(files), "labels")
        if moved.where("was <> label").isEmpty():
            remove(spark, kept, path)
            return moved.select("node", "label"), new
        remove(spark, kept)
        labels, kept = moved.select("node", "label"), new


def joined(classes: DataFrame, links: DataFrame) -> tuple[DataFrame, list[str]]:
    """classes (uid, label) after further links (a, b): components of the classes, not of the texts."""
    ends = links.join(classes.toDF("a", "la"), "a").join(classes.toDF("b", "lb"), "b")
    merged, path = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b"))
    new, kept = materialize(classes.join(merged.toDF("label", "_new"), "label", "left").select("uid", F.coalesce("_new", "label").alias("label")), "classes")
    return new, [path, kept]


def linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame, str]:
    """The pairs (a, b) whose exact similarity reaches the threshold, with it."""
    left = sets.select(F.col("uid").alias("a"), F.col("hashes").alias("ha"), F.col("counts").alias("ca"))
    right = sets.select(F.col("uid").alias("b"), F.col("hashes").alias("hb"), F.col("counts").alias("cb"))
    found = pairs.join(left, "a").join(right, "b").select("a", "b", similarity("ha", "ca", "hb", "cb").alias("similarity"))
    return materialize(found.where(F.col("similarity") >= threshold), "links")


def pairs_in_buckets(rows: DataFrame) -> DataFrame:
    """a, b: pairs of rows (bucket, blocks, uid, lead, label, bands, signature) of one bucket, in the first bucket that they
    share, of different labels, none of them the lead, whose estimate is near the threshold."""
    block = F.pmod(F.xxhash64("uid", "bucket"), F.col("blocks"))
    dealt = rows.withColumn("block", block.cast("int"))
    part = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least("block", j) * F.col("blocks") + F.greatest("block", j))
    dealt = dealt.where("uid <> lead").withColumn("part", F.explode(part)).select("bucket", "part", "blocks", "block", "uid", "label", "bands", "signature")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket", "part"]):
            bucket, part, blocks, block, uid, label = (table.column(c).to_numpy() for c in ("bucket", "part", "blocks", "block", "uid", "label"))
            bands, signature = (table.column(c).combine_chunks().flatten().to_numpy().reshape(len(uid), -1) for c in ("bands", "signature"))
            within = part // blocks == part % blocks  # a block with itself; else only rows of its two blocks
            k, step = np.arange(len(uid) - 1), 1
            while len(k):
                j = k + step
                k, j = k[j < len(uid)], j[j < len(uid)]
                one = (bucket[k] == bucket[j]) & (part[k] == part[j])  # rows are sorted: what fails now fails from here on
                k, j = k[one], j[one]
                apart = (label[k] != label[j]) & (within[k] | (block[k] != block[j]))
                for i in range(0, int(apart.sum()), PAIRS):
                    x, y = k[apart][i : i + PAIRS], j[apart][i : i + PAIRS]
                    near = unequal_slots(signature[x], signature[y]) <= MOST_UNEQUAL
                    x, y = x[near], y[near]
                    first = (bands[x] == bands[y]).argmax(1)
                    once = bands[x, first] == bucket[x]
                    x, y = uid[x[once]], uid[y[once]]
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
                step += 1

    return dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(giving_back(pairs), "a long, b long")


def unequal_slots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many 4-bit slots of packed signatures differ, row by row."""
    differ = (x ^ y).view(np.uint64)
    differ = differ | (differ >> np.uint64(1))
    differ = (differ | (differ >> np.uint64(2))) & np.uint64(0x1111111111111111)
    return np.bitwise_count(differ).sum(1, dtype=np.int64)


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id of every row of docs; n_links: how many other texts were verified as links of its text (pairs
    within a class found before aren't verified); near_id, similarity: the most similar of those."""
    spark = docs.sparkSession
    signs, signs_path = materialize(signed(docs, id_col, text_col), "signatures", TEXT_ROWS)
    scratch = [signs_path]

    def keep(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        out, path = materialize(df, name, rows)
        scratch.append(path)
        return out

    nodes = signs.groupBy("digest").agg(F.min("id").alias("least"), F.first("worded").alias("worded"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    odd = odd_ids(signs)
    if odd:  # a number for each text, in the order of its id
        nodes = keep(nodes.orderBy(F.asc_nulls_last("least"), "digest").withColumn("uid", F.monotonically_increasing_id()), "nodes")
    else:
        nodes = keep(nodes.withColumn("uid", F.col("least")), "nodes")

    # counts and leads are written, so that Spark can split a large bucket where they are joined
    slots = nodes.where("worded").select("uid", F.explode("bands").alias("bucket"))
    full = keep(slots.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    shared = keep(slots.join(full, "bucket").select("bucket", "uid", "n"), "buckets")
    # a text that shares many slots is in the middle of its group: each bucket is led by the most central one
    central = shared.groupBy("uid").agg(F.sum("n").alias("central"))
    leads = shared.join(central, "uid").groupBy("bucket").agg(F.max(F.struct("central", (-F.col("uid")).alias("less"))).alias("top"))
    leads = keep(leads.select("bucket", F.col("top.central").alias("central"), (-F.col("top.less")).alias("lead")), "leads")
    members = keep(shared.join(leads, "bucket").select("bucket", "uid", "lead", "central"), "members")

    involved = members.select("uid").distinct()
    first_rows = nodes.join(involved, "uid").select("uid", "least", F.col("digest").alias("_digest"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(text)).alias("digest"), text.alias("text")).hint("merge")
    texts = texts.join(first_rows, F.col("id").eqNullSafe(F.col("least")) & (F.col("digest") == F.col("_digest"))).select("uid", "text")
    sets = keep(shingle_sets(texts.dropDuplicates(["uid"]) if odd else texts), "shingles", TEXT_ROWS)
    signature = nodes.select("uid", "signature")

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs whose estimate is near the threshold or above."""
        named = pairs.join(signature.toDF("a", "sa"), "a").join(signature.toDF("b", "sb"), "b")
        return named.where(likely("sa", "sb")).select("a", "b")

    def apart(classes: DataFrame, pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are in different classes."""
        return pairs.join(classes.toDF("a", "la"), "a").join(classes.toDF("b", "lb"), "b").where("la <> lb").select("a", "b")

    ordered = [F.least("lead", "uid").alias("a"), F.greatest("lead", "uid").alias("b")]
    # round 1: each text with the most central lead of its buckets
    best = F.max(F.struct("central", (-F.col("lead")).alias("less"))).alias("top")
    first = keep(members.where("lead <> uid").groupBy("uid").agg(best).select("uid", (-F.col("top.less")).alias("lead")).select(*ordered).distinct(), "pairs")
    links, at = linked(near(first), sets, threshold)
    classes, paths = joined(involved.withColumn("label", F.col("uid")), links)
    scratch += [at, *paths]
    # round 2: with the other leads
    others = members.where("lead <> uid").select(*ordered).distinct().join(first, ["a", "b"], "left_anti")
    more, at = linked(near(apart(classes, others)), sets, threshold)
    links = links.union(more)
    classes, paths = joined(classes, more)
    scratch += [at, *paths]
    # round 3: whatever still stands apart in a bucket
    named = members.join(classes, "uid").select("bucket", "uid", "lead", "label")
    torn = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low <> high")
    torn = keep(torn.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "torn")
    mixed = named.join(torn, "bucket").join(nodes.select("uid", "bands", "signature"), "uid")
    last, at = linked(pairs_in_buckets(mixed), sets, threshold)
    scratch.append(at)
    if not last.isEmpty():
        classes, paths = joined(classes, last)
        scratch += paths
    links = links.union(last)

    both = links.union(links.select("b", "a", "similarity")).toDF("uid", "other", "similarity")
    nearest = both.groupBy("uid").agg(F.count("*").alias("n_links"), F.max(F.struct("similarity", (-F.col("other")).alias("less"))).alias("top"))
    named_ids = nodes.select("uid", "least")
    found = nodes.select("digest", "uid").join(classes, "uid", "left").withColumn("label", F.coalesce("label", "uid")).join(nearest, "uid", "left")
    found = found.join(named_ids.toDF("label", "class_id"), "label").withColumn("other", -F.col("top.less")).join(named_ids.toDF("other", "near_id"), "other", "left")
    found = keep(found.select("digest", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "near_id", "top.similarity"), "text-classes")
    out = signs.select(F.col("id").alias("doc_id"), "digest").join(found, "digest").drop("digest")
    result, _ = materialize(out, "near-classes")
    remove(spark, *scratch)
    return result


def odd_ids(rows: DataFrame) -> bool:
    """Whether an id is null or stands more than once."""
    return not rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL").isEmpty()


def representatives(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One document of each class: the row whose id names it. Ids of docs must be of one row each and not null."""
    kept = free_name("_kept", docs)
    named = classes.where("doc_id = class_id").select(F.col("doc_id").alias(kept))
    return docs.join(named, F.col(id_col) == F.col(kept), "left_semi")


def class_sizes(classes: DataFrame) -> DataFrame:
    """class_id, n of the classes of two documents or more."""
    return classes.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1")
