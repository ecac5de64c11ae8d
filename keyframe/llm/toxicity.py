"""Toxicity: a counterfactual-regularised linear classifier.

Features of a text are its different lower-cased words and the leading 4 and 5
characters of each. The classifier is a logistic model; besides the usual loss it pays
`counterfactual` times the squared change of its score when the identity terms of a
labelled text are swapped for others of their group, so that a neutral mention of a
group is not what makes a text toxic.

Fit: about `fit_rows` labelled rows (a documented bound; all of them if there are
fewer) give each feature's counts by label, summed in Spark; the `most_features` of
highest chi-square form the vocabulary; the rows, reduced to those features, go to the
driver, whose size is bounded by fit_rows and most_features. Scoring is one pass over
the whole texts without a shuffle.

Defined results: a null or empty text gets the score of a text without features, a
text of other columns' names is not affected, rows without a label aren't learned,
labels other than 0 and 1 aren't learned, and with only one label (or none) learned
every score is that label's share (0 for none); a row whose id has several labels
counts once for each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, materialize

FEATURE_BITS = 20
FIT_ROWS = 20_000
MOST_FEATURES = 20_000
LEAST_CHI2 = 12.0
THRESHOLD = 0.3

#: Groups of terms that may stand for one another, a small default; callers give their own.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)

EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def words_of(text: str, plain: dict[str, str]) -> set[str]:
    """The different words of a text, without the signs around them; `plain` remembers raw words."""
    raw = set(text.lower().split())
    for x in raw:
        if x not in plain:
            plain[x] = EDGES.sub("", x)
    out = {plain[x] for x in raw}
    out.discard("")
    return out


def features_of(word: str) -> tuple[int, ...]:
    """Feature numbers of a word: itself and its beginnings."""
    code = lambda kind, part: zlib.crc32(f"{kind}{part}".encode()) >> (32 - FEATURE_BITS)
    return (code("w", word), *(code(f"p{n}", word[:n]) for n in (4, 5) if len(word) >= n))


@dataclass
class ToxicityModel:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -20.0

    def word_score(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features_of(word))


def feature_counts(rows: DataFrame) -> DataFrame:
    """feature, pos, neg: in how many rows of each label (columns text, label) a feature stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, plain = np.zeros((2, 1 << FEATURE_BITS), np.int64), {}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[label, list({f for w in words_of(text or "", plain) for f in features_of(w)})] += 1
        at = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[1, at]), pa.array(sums[0, at])], names=["feature", "pos", "neg"])

    return rows.mapInArrow(count, "feature int, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def swaps(words: set[str], groups: tuple[tuple[str, ...], ...]) -> list[tuple[str, str]]:
    """(term, other term) for each identity term of a text: the next of its group that the text doesn't hold."""
    out = []
    for group in groups:
        for i, term in enumerate(group):
            if term in words:
                other = next((group[(i + j) % len(group)] for j in range(1, len(group)) if group[(i + j) % len(group)] not in words), None)
                if other:
                    out.append((term, other))
    return out


def reduced_rows(rows: DataFrame, vocabulary: dict[int, int], groups: tuple[tuple[str, ...], ...]) -> DataFrame:
    """label, x (the vocabulary's features of the text, at most all of it, once each) and n (how many words have each), minus and plus
    (what swapping the identity terms takes and adds)."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain: dict[str, str] = {}
        place = lambda word: [vocabulary[f] for f in features_of(word) if f in vocabulary]
        for batch in batches:
            x, n, minus, plus = [], [], [], []
            for text in batch.column(0).to_pylist():
                words = words_of(text or "", plain)
                pairs = swaps(words, groups)
                held = Counter(v for w in words for v in place(w))
                x.append(list(held))
                n.append(list(held.values()))
                minus.append([v for a, _ in pairs for v in place(a)])
                plus.append([v for _, b in pairs for v in place(b)])
            lists = [pa.array(c, pa.list_(pa.int32())) for c in (x, n, minus, plus)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *lists], names=["label", "x", "n", "minus", "plus"])

    return rows.mapInArrow(reduce, "label int, x array<int>, n array<int>, minus array<int>, plus array<int>")


class Sparse:
    """Rows of column numbers (repeats add up), each with its value, 1 if none are given."""

    def __init__(self, rows: list, n_cols: int, values: list | None = None) -> None:
        sizes = np.array([len(r) for r in rows], np.int64)
        flat = lambda lists, kind: np.concatenate([np.asarray(r, kind) for r in lists]) if sizes.sum() else np.zeros(0, kind)
        self.cols = flat(rows, np.int64)
        self.values = np.ones(len(self.cols)) if values is None else flat(values, np.float64)
        self.rows, self.shape = np.repeat(np.arange(len(rows)), sizes), (len(rows), n_cols)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols] * self.values, self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, r[self.rows] * self.values, self.shape[1])


def fit_weights(x: list, values: list, minus: list, plus: list, label: np.ndarray, n: int, counterfactual: float, l2: float = 2e-5, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Minimise the logistic loss, l2 and the counterfactual penalty by full-batch Adam steps."""
    pairs = [i for i in range(len(x)) if len(minus[i])]
    data, less, more = Sparse(x, n, values), Sparse([minus[i] for i in pairs], n), Sparse([plus[i] for i in pairs], n)
    w, b = np.zeros(n), float(np.log(label.mean() / (1 - label.mean())))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(data.dot(w) + b, -30, 30)))
        r = (p - label) / len(label)
        g = data.back(r) + l2 * w
        if pairs:
            change = (more.dot(w) - less.dot(w)) * (2 * counterfactual / len(pairs))
            g += more.back(change) - less.back(change)
        g = np.append(g, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit_toxicity_model(rows: DataFrame, fit_rows: int = FIT_ROWS, most_features: int = MOST_FEATURES, counterfactual: float = 1.0, groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> ToxicityModel:
    """Learn from rows of text and label (0 or 1)."""
    rows = rows.where(F.col("label").isin(0, 1)).select("text", F.col("label").cast("int").alias("label"))
    by_label = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(by_label.values())
    if len(by_label) < 2:
        return ToxicityModel(bias=20.0 if 1 in by_label else -20.0)
    share = min(1.0, fit_rows / total)
    sample = rows.where(F.pmod(F.xxhash64("text", F.lit("fit")), F.lit(1_000_000)) < int(1_000_000 * share) + 1)
    counts = feature_counts(sample)
    ends = sample.groupBy("label").agg(F.count("*").alias("n")).collect()
    n1, n0 = (max(1, sum(r["n"] for r in ends if r["label"] == k)) for k in (1, 0))
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
    c, d = n1 - a, n0 - b
    chi2 = (n1 + n0) * F.pow(a * d - b * c, 2.0) / F.greatest(F.lit(1e-9), (a + b) * (c + d) * n1 * n0)
    best = counts.withColumn("chi2", chi2).where((F.col("chi2") >= LEAST_CHI2) & (a + b >= 3)).orderBy(F.desc("chi2"), "feature").limit(most_features)
    vocabulary = {r["feature"]: i for i, r in enumerate(best.select("feature").collect())}
    train = reduced_rows(sample, vocabulary, groups).toPandas()
    label = train["label"].to_numpy(float)
    if not 0 < label.mean() < 1:
        return ToxicityModel(bias=float(np.log(by_label[1] / by_label[0])))
    w, bias = fit_weights(list(train["x"]), list(train["n"]), list(train["minus"]), list(train["plus"]), label, len(vocabulary), counterfactual)
    return ToxicityModel({f: float(w[i]) for f, i in vocabulary.items() if abs(w[i]) > 1e-6}, bias)


def toxicity_score(model: ToxicityModel, text: Column) -> Column:
    """Probability of label 1 of a text column."""

    @F.arrow_udf(T.DoubleType())
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        plain: dict[str, str] = {}
        known: dict[str, float] = {}
        for texts in parts:
            out = np.empty(len(texts))
            for i, text in enumerate(texts.to_pylist()):
                if len(plain) > 300_000:
                    plain, known = {}, {}
                words = words_of(text or "", plain)
                for w in words:
                    if w not in known:
                        known[w] = model.word_score(w)
                out[i] = model.bias + sum(sorted(v for v in map(known.__getitem__, words) if v))
            yield pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **fit) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, learned from the labelled rows that aren't held out."""
    fit_rows = fit.get("fit_rows", FIT_ROWS)
    known = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).alias("label"))
    known = known.where("_id IS NOT NULL").groupBy("_id").agg(F.max("label").alias("label"))  # of an id's labels the greatest
    share = min(1.0, fit_rows / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("_id", F.lit("fit")), F.lit(1_000_000)) < int(1_000_000 * share) + 1)
    texts = docs.where(~held_out(id_col)).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # about fit_rows ids and labels: the texts stay where they are
    sample, _ = materialize(texts.join(F.broadcast(picked), "_id").select("text", "label"), "toxicity-sample")
    model = fit_toxicity_model(sample, **fit)
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), toxicity_score(model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
