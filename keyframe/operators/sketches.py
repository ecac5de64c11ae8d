"""Sketches as tables, so that they are built, merged and asked with ordinary aggregates.

A Bloom filter is the set of its bit numbers, a Count-Min sketch the counts of its cells:
a merge is a union, a query a join. Distinct counts use Spark's HLL sketch columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bloom_size(capacity: int, error: float) -> tuple[int, int]:
    """Bits and hashes for a capacity and a false positive rate."""
    bits = math.ceil(-capacity * math.log(error) / math.log(2) ** 2)
    return bits, max(1, round(bits / capacity * math.log(2)))


def bit_numbers(item: Column, bits: int, hashes: int) -> Column:
    """Double hashing: h1 + i * h2."""
    h1, h2 = F.xxhash64(item), F.xxhash64(item, F.lit("second"))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(F.shiftright(h1, 2) + i * F.shiftright(h2, 8), F.lit(bits).cast("long")))


def bloom(rows: DataFrame, item: str, bits: int, hashes: int, key: str = "key") -> DataFrame:
    """BF.ADD, BF.MADD: (key, bit)."""
    return rows.select(key, F.explode(bit_numbers(F.col(item), bits, hashes)).alias("bit")).distinct()


def bloom_contains(filter_bits: DataFrame, request: DataFrame, item: str, bits: int, hashes: int, key: str = "key") -> DataFrame:
    """BF.EXISTS, BF.MEXISTS: requested (key, item) with a flag; no false negatives."""
    asked = request.select(key, item).distinct().withColumn("bit", F.explode(F.array_distinct(bit_numbers(F.col(item), bits, hashes))))
    held = asked.join(filter_bits.withColumn("_set", F.lit(1)), [key, "bit"], "left")
    return held.groupBy(key, item).agg((F.count("*") == F.count("_set")).alias("found"))


def cuckoo(log: DataFrame, item: str = "item", key: str = "key", delta: str = "delta") -> DataFrame:
    """CF.ADD, CF.DEL: how often each 16-bit fingerprint is held in its pair of buckets (0 and less: not held). A table of
    fingerprints instead of slots: nothing is evicted, and there is no capacity to fill; CF.RESERVE's size is the number of buckets."""
    return log.groupBy(key, *cuckoo_place(item)).agg(F.sum(delta).alias("held")).where("held > 0")


def cuckoo_place(item: str, buckets: int = 1 << 20) -> list[Column]:
    """Fingerprint and the lower of the two buckets that it may lie in."""
    print_ = (F.pmod(F.xxhash64(item), F.lit(65535)) + 1).cast("int")
    first = F.pmod(F.xxhash64(item, F.lit("bucket")), F.lit(buckets))
    second = first.bitwiseXOR(F.pmod(F.xxhash64(print_), F.lit(buckets)))
    return [print_.alias("fingerprint"), F.least(first, second).alias("bucket")]


def cuckoo_contains(held: DataFrame, request: DataFrame, item: str = "item", key: str = "key") -> DataFrame:
    asked = request.select(key, item, *cuckoo_place(item))
    return asked.join(held, [key, "fingerprint", "bucket"], "left").select(key, item, F.col("held").isNotNull().alias("found"))


def cms_size(error: float, confidence: float) -> tuple[int, int]:
    """Width and depth."""
    return math.ceil(math.e / error), math.ceil(math.log(1 / (1 - confidence)))


def cms(rows: DataFrame, item: str, n: Column, width: int, depth: int, key: str = "key") -> DataFrame:
    """CMS.INCRBY: (key, row, cell, n). Items are summed first, so a hot one is one row per task."""
    sums = rows.groupBy(key, item).agg(F.sum(n).alias("n"))
    cells = sums.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    return cells.groupBy(key, "row", F.pmod(F.xxhash64(item, "row"), F.lit(width)).alias("cell")).agg(F.sum("n").alias("n"))


def cms_query(cells: DataFrame, request: DataFrame, item: str, width: int, depth: int, key: str = "key") -> DataFrame:
    """CMS.QUERY: the least cell of each item, never below its true count."""
    asked = request.select(key, item).distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    asked = asked.withColumn("cell", F.pmod(F.xxhash64(item, "row"), F.lit(width)))
    return asked.join(cells, [key, "row", "cell"], "left").groupBy(key, item).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def top_k(rows: DataFrame, item: str, k: int, key: str = "key") -> DataFrame:
    """TOPK.LIST, exact: the k most frequent items of each key, ties to the smaller item."""
    from pyspark.sql import Window

    counts = rows.groupBy(key, item).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), item))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def distinct_sketch(rows: DataFrame, item: str, key: str = "key", lg_k: int = 14) -> DataFrame:
    """PFADD: an HLL sketch per key."""
    return rows.groupBy(key).agg(F.hll_sketch_agg(item, F.lit(lg_k)).alias("sketch"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """PFMERGE and PFCOUNT of all rows."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def cuckoo_add_new(held: DataFrame, items: DataFrame, item: str = "item", key: str = "key") -> DataFrame:
    """CF.ADDNX: the filter with the items whose fingerprints it doesn't hold, once each."""
    new = items.select(key, *cuckoo_place(item)).distinct().withColumn("held", F.lit(1).cast(held.schema["held"].dataType))
    return held.unionByName(new.join(held, [key, "fingerprint", "bucket"], "left_anti").select(*held.columns))


def cuckoo_info(held: DataFrame, key: str = "key") -> DataFrame:
    """CF.INFO: items held and pairs of buckets in use."""
    return held.groupBy(key).agg(F.sum("held").alias("items"), F.countDistinct("bucket").alias("buckets"))
