"""Running sums, maxima and time windows of keys that are too large for one task.

A key's rows are cut into blocks of their order column. What stands before a block is one
row per block, so a running value is a window over those and one inside the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before(rows: DataFrame, keys: list[str], order: str, size: float, name: str, value: Column, fold, merge=None, *ties: str) -> DataFrame:
    """rows with `name`: fold (F.max, F.sum ..) of value over all rows of the keys before each in the order of (order, ties), null for
    the first. Blocks hold `size` of the order column; merge: what folds the blocks' results, if not fold itself."""
    merge = merge or fold
    block = F.floor(F.col(order) / size)
    cut = rows.withColumn("_block", block).withColumn("_value", value)
    sums = cut.groupBy(*keys, "_block").agg(fold("_value").alias("_all"))
    ahead = merge("_all").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_block").alias("_kb"), ahead.alias("_ahead"))
    inside = fold("_value").over(Window.partitionBy(*keys, "_block").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1))
    on = F.col("_block").eqNullSafe(F.col("_kb"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = cut.withColumn("_inside", inside).join(starts, on)
    both = F.array_compact(F.array("_ahead", "_inside"))
    value = {F.max: F.array_max(both), F.min: F.array_min(both)}.get(merge)
    if value is None:
        value = F.when(F.size(both) > 0, F.coalesce("_ahead", F.lit(0)) + F.coalesce("_inside", F.lit(0)))
    return joined.select(*rows.columns, value.alias(name))


def within_time(rows: DataFrame, keys: list[str], ts: str, span: int, **values: Column) -> DataFrame:
    """rows with counts and sums of integers over the rows of their keys in the `span` that ends with each (itself and those of its
    time with it). A row enters at its time, in its block of `span`, and leaves `span` later, in the next: what a block starts with,
    and has entered, less what has left. So all are running values, which cost the same however many rows a window holds."""
    block = F.floor(F.col(ts) / span)
    moved = rows.withColumn("_left", F.explode(F.array(F.lit(False), F.lit(True)))).where(~F.col("_left") | F.col(ts).isNotNull())
    moved = moved.withColumn("_at", F.col(ts) + F.when(F.col("_left"), F.lit(span)).otherwise(F.lit(0))).withColumn("_block", block + F.col("_left").cast("int"))
    sums = rows.where(F.col(ts).isNotNull()).groupBy(*keys, (block + 1).alias("_block")).agg(*(v.alias(f"_all_{n}") for n, v in values.items()))
    starts = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_block").alias("_kb"), *(f"_all_{n}" for n in values))
    side = Window.partitionBy(*keys, "_block", "_left").orderBy("_at")
    both = Window.partitionBy(*keys, "_block").orderBy("_at")
    zero = F.lit(0)
    for name, value in values.items():
        moved = moved.withColumn(f"_run_{name}", value.over(side))
    for name in values:
        gone = F.last(F.when(F.col("_left"), F.coalesce(f"_run_{name}", zero)), ignorenulls=True).over(both)
        moved = moved.withColumn(f"_gone_{name}", gone)
    on = F.col("_block").eqNullSafe(F.col("_kb"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = moved.where("not _left").join(starts, on, "left")
    total = lambda n: F.coalesce(f"_all_{n}", zero) + F.coalesce(f"_run_{n}", zero) - F.coalesce(f"_gone_{n}", zero)
    return joined.select(*rows.columns, *(total(n).alias(n) for n in values))
