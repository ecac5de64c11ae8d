"""Language ID by error-correcting output codes.

Every language gets a codeword; a binary n-gram classifier per bit (weights of byte
bigrams and trigrams of the lower-cased text) says how likely the bit is 1. Decoding
takes the codeword with the least loss, each bit's loss weighted by how well its
classifier separates, and flags a text whose two nearest codewords are close.

Fit: n-gram counts by language over all training rows, summed per task and then by
Spark; the counts that reach the driver have at most (n-gram buckets x languages)
rows. The mean and variance of each bit's margin, from a sample of about
`calibration_rows` training rows, turn margins into probabilities. The model is a
fixed-size array that goes to the tasks with the function.

Defined results: a null text, or one without a letter, is `und` with score 0; a null
language isn't learned; if no language can be learned every text is `und`; repeated
rows count as often as they stand; no text is cut; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, give_back, giving_back, held_out, slices, text_column

UNDETERMINED = "und"
GRAMS = 1 << 17  # bigrams fill the first half, hashed trigrams the second
CALIBRATION_ROWS = 20_000
#: Languages that are learned; the counts on the driver are bounded by them.
MOST_LANGUAGES = 1000
SMOOTHING = 0.5

#: Bytes that aren't ASCII letters or part of another script count as a space.
FOLD = np.full(256, 32, np.uint8)
FOLD[128:] = np.arange(128, 256)
FOLD[97:123] = np.arange(97, 123)


def folded(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(text_column(column))


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bigram code, trigram code, row) at each position with two bytes to follow in its row, all-space ones left out."""
    b = FOLD[data].astype(np.uint32)
    if len(b) < 3:
        none = np.zeros(0, np.uint32)
        return none, none, none.astype(np.int64)
    two = (b[:-2] << 8) | b[1:-1]
    three = (two << 8) | b[2:]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = (row[:-2] == row[2:]) & (three != 0x202020)
    two, three = two[keep], three[keep]
    hashed = (three * np.uint32(2654435761)) >> np.uint32(16)
    return two, hashed + np.uint32(GRAMS // 2), row[:-2][keep]


def codewords(n: int) -> np.ndarray:
    """n different rows of 0 and 1, far apart: exhaustive codes for few classes, the best of some seeded dense codes for many."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:  # all splits of the classes in two
        return np.array([[(k >> i) & 1 for k in range(1, 1 << (n - 1))] for i in range(n)], np.int8)
    bits = int(np.ceil(10 * np.log2(n)))
    tries = [np.random.default_rng(seed).integers(0, 2, (n, bits)) for seed in range(max(1, min(50, (1 << 24) // (n * n))))]
    return max(tries, key=least_distance).astype(np.int8)


def least_distance(code: np.ndarray) -> int:
    """Places in which the two nearest codewords differ; negative by the number of bits that are the same for all."""
    ones = code.astype(np.int32)
    apart = ones.sum(1)[:, None] + ones.sum(1)[None, :] - 2 * (ones @ ones.T)
    np.fill_diagonal(apart, code.shape[1])
    return int(apart.min()) - code.shape[1] * int((code == code[0]).all(0).sum())


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # n-grams x bits, log odds
    scale: np.ndarray  # a bit's log odds are scale * margin + shift
    shift: np.ndarray
    trust: np.ndarray  # weight of a bit's loss


def count_grams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, gram, n over all rows of docs, pre-summed in each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for first, data, offsets in slices(folded(batch.column(0))):
                two, three, row = grams(data, offsets)
                own = langs[first : first + len(offsets) - 1]
                for lang in set(own):
                    pick = (own == lang)[row]
                    total = sums.setdefault(lang, np.zeros(GRAMS, np.int64))
                    total += np.bincount(two[pick], minlength=GRAMS) + np.bincount(three[pick], minlength=GRAMS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(total[at])], names=["lang", "gram", "n"])

    return docs.select(text_col, lang_col).mapInArrow(giving_back(count), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def margins(model: LanguageModel, column: pa.Array) -> np.ndarray:
    """The mean log odds of each bit over a text's n-grams: rows x bits, 0 for a text without any."""
    out = np.zeros((len(column), model.code.shape[1]), np.float64)
    for first, data, offsets in slices(folded(column), 1 << 18):
        two, three, row = grams(data, offsets)
        if not len(row):
            continue
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        value = model.weights[two]
        value += model.weights[three]
        total = np.add.reduceat(value, starts, axis=0, dtype=np.float64)
        out[first + row[starts]] = total / np.diff(np.r_[starts, len(row)])[:, None]
    return out


def fit_language_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", calibration_rows: int = CALIBRATION_ROWS, most_languages: int = MOST_LANGUAGES) -> LanguageModel:
    """Learn from the rows of docs that have a language and a text; where there are more than most_languages, the most frequent ones."""
    train = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = train.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    languages = sorted(r["lang"] for r in found)
    bits = np.ones(1)
    if len(languages) <= 1:  # nothing to tell apart
        return LanguageModel(languages, codewords(len(languages)), np.zeros((GRAMS, 1), np.float32), bits, bits * 0, bits)
    train = train.where(F.col("lang").isin(languages))
    counts = count_grams(train, "text", "lang").toPandas()  # a row for each n-gram of each language
    total = np.zeros((len(languages), GRAMS))
    total[counts["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), counts["gram"].to_numpy()] = counts["n"]
    code = codewords(len(languages))
    share = total / np.maximum(1, total.sum(1, keepdims=True))  # each language has the same say
    seen = total.sum(0) > 0
    prior = SMOOTHING / max(1, seen.sum()) / 100
    weights = np.zeros((GRAMS, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        one, zero = code[:, bit] == 1, code[:, bit] == 0
        if one.any() and zero.any():
            odds = np.log(share[one].mean(0) + prior) - np.log(share[zero].mean(0) + prior)
            weights[seen, bit] = odds[seen]
    bits = np.ones(code.shape[1])
    return calibrated(LanguageModel(languages, code, weights, bits, bits * 0, bits), train, sum(r["n"] for r in found), calibration_rows)


def calibrated(model: LanguageModel, train: DataFrame, rows: int, calibration_rows: int) -> LanguageModel:
    """Set scale, shift and trust from the margins' moments on a sample: two normal classes of one variance."""
    number = {x: i for i, x in enumerate(model.languages)}
    width = model.code.shape[1]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(number), 1 + 2 * width))
        for batch in batches:
            m = margins(model, batch.column(0))
            np.add.at(sums, [number[x] for x in batch.column(1).to_pylist()], np.hstack([np.ones((len(m), 1)), m, m * m]))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(number)), pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], names=["i", "sums"])

    sample = train.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, calibration_rows / max(1, rows))) + 1)
    parts = sample.mapInArrow(giving_back(moments), "i int, sums array<double>").select("i", F.posexplode("sums").alias("k", "v")).groupBy("i", "k").agg(F.sum("v").alias("v"))
    sums = np.zeros((len(number), 1 + 2 * width))
    for r in parts.collect():
        sums[r["i"], r["k"]] = r["v"]
    n = np.maximum(sums[:, :1], 1e-9)
    mean, square = sums[:, 1 : 1 + width] / n, sums[:, 1 + width :] / n
    there = sums[:, 0] > 0
    scale, shift, trust = np.ones(width), np.zeros(width), np.zeros(width)
    for bit in range(width):
        one, zero = there & (model.code[:, bit] == 1), there & (model.code[:, bit] == 0)
        if not one.any() or not zero.any():
            continue
        m1, m0 = mean[one, bit].mean(), mean[zero, bit].mean()
        spread = (square[there, bit] - mean[there, bit] ** 2).mean() + (mean[one, bit].var() + mean[zero, bit].var()) / 2 + 1e-6
        scale[bit], shift[bit] = (m1 - m0) / spread, (m0 * m0 - m1 * m1) / (2 * spread)
        trust[bit] = max(0.0, m1 - m0) / np.sqrt(spread)  # distance of the classes in deviations
    return LanguageModel(model.languages, model.code, model.weights, scale, shift, trust / max(trust.sum(), 1e-9))


def decode(model: LanguageModel, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, score, gap to the runner-up's score) by least weighted logistic loss."""
    odds = np.clip(margin * model.scale + model.shift, -30, 30)
    loss1, loss0 = np.logaddexp(0, -odds), np.logaddexp(0, odds)
    loss = (loss1 * model.trust) @ model.code.T + (loss0 * model.trust) @ (1 - model.code.T)
    near = np.exp(-(loss - loss.min(1, keepdims=True)))
    near /= near.sum(1, keepdims=True)
    order = np.sort(near, axis=1)
    gap = order[:, -1] - order[:, -2] if near.shape[1] > 1 else order[:, -1]
    return near.argmax(1), order[:, -1], gap


PREDICTED = "struct<lang_pred:string,score:double,gap:double,ambiguous:boolean>"


def predict_language(model: LanguageModel, text: Column, ambiguous_below: float = 0.1) -> Column:
    """lang_pred, score, gap and the ambiguity flag of a text column."""

    @F.arrow_udf(PREDICTED)
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            plain = text_column(texts)
            lettered = pc.match_substring_regex(plain, r"\p{L}").to_numpy(zero_copy_only=False)
            if model.languages:
                best, score, gap = decode(model, margins(model, texts))
                names = np.array(model.languages, object)[best]
            else:
                names, score, gap = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts)), np.zeros(len(texts))
            names, score, gap = np.where(lettered, names, UNDETERMINED), np.where(lettered, score, 0.0), np.where(lettered, gap, 0.0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(gap), pa.array(gap < ambiguous_below)], ["lang_pred", "score", "gap", "ambiguous"])
        give_back()

    return predict(text)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row, learned from the rows that aren't held out."""
    model = fit_language_model(docs.where(~held_out(id_col)), text_col, lang_col)
    found = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), predict_language(model, F.col(text_col)).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.ambiguous")


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows whose language can't be told (`und`): no letter, or no text."""
    model = fit_language_model(docs.where(~held_out(id_col)), text_col, lang_col)
    found = free_name("_language", docs)
    rows = docs.withColumn(found, predict_language(model, F.col(text_col)))
    return rows.where(F.col(found)["lang_pred"] != UNDETERMINED).select(*docs.columns)

