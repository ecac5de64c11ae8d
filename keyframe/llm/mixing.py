"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document gets an exponential key `-ln(u) / quality`, where u is drawn from a
digest of its id, so reruns agree. Sources get word budgets in proportion to their
weights (capped, with the excess reshared); a source's budget is spent on complete
epochs first and then on its documents in key order until the budget is met.

Plan: one scan of the texts (sizes and keys are written to the shared folder), one
aggregate by source, one aggregate by (source, key bucket) whose running sum gives
each bucket's start, and one window inside (source, bucket). Key buckets split a hot
source over many tasks; no task ever sorts a whole source. The sources themselves are
ordered in one task, a row for each: meant for up to some millions of sources.

Defined results: a null text has size 0, a null source is a source of its own (last),
a null id is drawn as the text "null", rows of size 0 take 0 words, repeated rows are
mixed row by row, an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize

WORD = r"[^\x20\x09-\x0D]+"


def document_quality(text: Column, size: Column) -> Column:
    """A positive quality weight: 1.5 at a mean of 5.5 characters a word, falling to 0.5 away from it."""
    mean = F.length(text) / size
    return F.when(size > 0, 0.5 + 1.0 / (1.0 + F.abs(mean - 5.5))).otherwise(1.0)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    buckets: int = 4096,
) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs.

    weights repeat over the sources in code point order; all sources together get
    `share` times all words, no source over `most` (1 or more) times its own.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    draw = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), text.alias("body"), draw.alias("draw")
    ).select("doc_id", "source", "size", (-F.log("draw") / document_quality(F.col("body"), F.col("size"))).alias("key"))
    # the bucket rises with the key: a key of mean 1 fills the buckets about evenly
    rows = rows.withColumn("bucket", F.floor((1.0 - F.exp(-F.col("key"))) * buckets).cast("int"))
    rows, _ = materialize(rows, "mix-rows")

    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(sums, weights, share, most)
    starts = (
        sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .select(F.col("source").alias("start_source"), F.col("bucket").alias("start_bucket"), "before", "source_size", "target", "epochs", "rest")
    )
    ahead = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    joined = ranked.join(starts, F.col("source").eqNullSafe(F.col("start_source")) & (F.col("bucket") == F.col("start_bucket")))
    partial = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("ahead")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + partial).cast("long").alias("taken"))


def source_targets(sums: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target, epochs, rest: a row for each source.

    Resharing ends where every source has min(most * size, level * weight). Ordered by
    most * size / weight, the level is the largest of (what is left after the sources
    before are full) / (the weight from here on).
    """
    by_source = sums.groupBy("source").agg(F.sum("bucket_size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sized = by_source.withColumn("place", place).withColumn("weight", weight).withColumn("full", F.col("source_size") * float(most))
    by_fill = Window.orderBy(F.col("full") / F.col("weight"), "place")
    everything = Window.partitionBy()
    full_before = F.coalesce(F.sum("full").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    budget = F.sum("source_size").over(everything) * float(share)
    filled = sized.withColumn("budget", budget).withColumn("full_before", full_before).withColumn("weight_left", weight_left)
    filled = filled.withColumn("level", F.max((F.col("budget") - F.col("full_before")) / F.col("weight_left")).over(everything))
    target = F.least(F.col("full"), F.col("level") * F.col("weight"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return (
        filled.withColumn("target", target)
        .withColumn("epochs", epochs)
        .withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
        .select("source", "source_size", "target", "epochs", "rest")
    )


def mixed_documents(docs: DataFrame, taken: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as the mix takes them: a row for each complete epoch, then the first words of a fractional one; rows of 0 words go.

    `taken` has one row for each distinct doc_id; its columns are dropped again.
    """
    own, size, most, words = (free_name(n, docs) for n in ("_mix_id", "_mix_size", "_mix_taken", "_mix_words"))
    plan = taken.select(F.col("doc_id").alias(own), F.col("size").alias(size), F.col("taken").alias(most)).dropDuplicates([own])
    rows = docs.join(plan, F.col(id_col).eqNullSafe(F.col(own))).where(F.col(most) > 0)
    copies = F.transform(
        F.sequence(F.lit(0).cast("long"), F.ceil(F.col(most) / F.col(size)) - 1),
        lambda i: F.least(F.col(size), F.col(most) - i * F.col(size)),
    )
    rows = rows.withColumn(words, F.explode(copies))
    parts = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.slice(parts, F.lit(1), F.col(words).cast("int")), " ")
    text = F.when(F.col(words) < F.col(size), cut).otherwise(F.col(text_col))
    return rows.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns))


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, COALESCE(text, '') AS body,
         CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS draw
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
         -ln(draw) / (CASE WHEN size > 0 THEN 0.5 + 1.0::DOUBLE / (1.0 + abs(CAST(length(body) AS DOUBLE) / size - 5.5)) ELSE 1.0 END) AS key
  FROM base),
by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
placed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS full_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM by_source),
weighted AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM placed),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - COALESCE(sum(full_size) OVER (ORDER BY full_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY full_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM weighted),
targets AS (
  SELECT source, source_size, least(full_size, max(lvl) OVER () * weight) AS target FROM levels),
epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
rests AS (
  SELECT *, CAST(round(target - epochs * source_size) AS BIGINT) AS rest FROM epochs),
ranked AS (
  SELECT *, COALESCE(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM keyed)
SELECT r.doc_id, r.size, t.source_size, t.target,
       CAST(t.epochs * r.size + greatest(0, least(r.size, t.rest - r.ahead)) AS BIGINT) AS taken
FROM ranked r JOIN rests t ON r.source IS NOT DISTINCT FROM t.source
"""
