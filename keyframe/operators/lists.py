"""Lists as rows (key, pos, value); positions only need to be in order.

Ranks come from windows by key. What fits one array value is better served by Spark's
array functions; the row form has no limit on a list's length beyond its window sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, key: str = "key", pos: str = "pos") -> DataFrame:
    """rows with index (from 0) and length."""
    order = Window.partitionBy(key).orderBy(pos)
    return rows.withColumn("index", F.row_number().over(order) - 1).withColumn("length", F.count("*").over(Window.partitionBy(key)))


def _at(i: int):
    return F.lit(i) if i >= 0 else F.col("length") + i


def range_of(rows: DataFrame, start: int, stop: int, key: str = "key", pos: str = "pos") -> DataFrame:
    """LRANGE: elements start .. stop, both included; negative ones count from the end. LTRIM keeps the same rows."""
    return ranked(rows, key, pos).where((F.col("index") >= _at(start)) & (F.col("index") <= _at(stop))).drop("length")


def element(rows: DataFrame, index: int, key: str = "key", pos: str = "pos") -> DataFrame:
    """LINDEX."""
    return range_of(rows, index, index, key, pos).drop("index")


def ends(rows: DataFrame, key: str = "key", pos: str = "pos", value: str = "value") -> DataFrame:
    """LPOP and RPOP of one element each, and LLEN, without a sort."""
    return rows.groupBy(key).agg(F.min_by(value, pos).alias("first"), F.max_by(value, pos).alias("last"), F.count("*").alias("length"))


def pop(rows: DataFrame, count: int = 1, left: bool = True, key: str = "key", pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """LPOP, RPOP, LMPOP: (popped, rest)."""
    order = Window.partitionBy(key).orderBy(F.col(pos).asc() if left else F.col(pos).desc())
    numbered = rows.withColumn("_n", F.row_number().over(order))
    return numbered.where(F.col("_n") <= count).drop("_n"), numbered.where(F.col("_n") > count).drop("_n")


def push(rows: DataFrame, new: DataFrame, left: bool = False, only_existing: bool = False, key: str = "key", pos: str = "pos") -> DataFrame:
    """LPUSH, RPUSH (and X forms): new rows (key, pos in order of arrival, value) before or behind the list."""
    if only_existing:
        new = new.join(rows.select(key).distinct(), key, "left_semi")
    edge = rows.groupBy(key).agg(F.min(pos).alias("_low"), F.max(pos).alias("_high"))
    number = F.row_number().over(Window.partitionBy(key).orderBy(pos))
    placed = new.withColumn("_n", number).join(edge, key, "left")
    place = F.coalesce("_low", F.lit(0)) - F.col("_n") if left else F.coalesce("_high", F.lit(0)) + F.col("_n")
    return rows.unionByName(placed.withColumn(pos, place.cast(rows.schema[pos].dataType)).select(*rows.columns))


def remove(rows: DataFrame, value, count: int = 0, key: str = "key", pos: str = "pos", value_col: str = "value") -> DataFrame:
    """LREM: without the first (last, if negative) count matches; all if 0."""
    hit = F.col(value_col) == F.lit(value)
    order = Window.partitionBy(key, hit).orderBy(F.col(pos).desc() if count < 0 else F.col(pos).asc())
    gone = hit & (F.row_number().over(order) <= abs(count)) if count else hit
    return rows.withColumn("_gone", F.coalesce(gone, F.lit(False))).where("NOT _gone").drop("_gone")


def positions(rows: DataFrame, value, rank: int = 1, count: int = 1, key: str = "key", pos: str = "pos", value_col: str = "value") -> DataFrame:
    """LPOS: the indexes of matches from the rank-th on (from the end if negative), at most count (0: all)."""
    hits = ranked(rows, key, pos).where(F.col(value_col) == F.lit(value))
    order = Window.partitionBy(key).orderBy(F.col("index").desc() if rank < 0 else F.col("index").asc())
    hits = hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") >= abs(rank))
    return (hits.where(F.col("_n") < abs(rank) + count) if count else hits).select(key, "index")


def insert(rows: DataFrame, pivot, new, before: bool = True, key: str = "key", pos: str = "pos", value_col: str = "value") -> DataFrame:
    """LINSERT: new beside the first pivot of each list that has one; positions become fractions."""
    spot = rows.where(F.col(value_col) == F.lit(pivot)).groupBy(key).agg(F.min(pos).alias("_p"))
    made = spot.select(F.col(key), (F.col("_p") + (-0.5 if before else 0.5)).alias(pos), F.lit(new).alias(value_col))
    return rows.withColumn(pos, F.col(pos).cast("double")).select(key, pos, value_col).unionByName(made)


def move(rows: DataFrame, source, target, from_left: bool = True, to_left: bool = False, count: int = 1, key: str = "key", pos: str = "pos") -> DataFrame:
    """LMOVE, RPOPLPUSH, LMOVEM: pop from the source list and push to the target, one element after the other."""
    taken, rest_of = pop(rows.where(F.col(key) == F.lit(source)), count, from_left, key, pos)
    rest = rest_of.unionByName(rows.where((F.col(key) != F.lit(source)) | F.col(key).isNull()))
    arriving = taken.withColumn(key, F.lit(target).cast(rows.schema[key].dataType)).withColumn(pos, F.col(pos) if from_left else -F.col(pos))
    return push(rest, arriving, to_left, key=key, pos=pos)


def set_at(rows: DataFrame, index: int, value, key: str = "key", pos: str = "pos", value_col: str = "value") -> DataFrame:
    """LSET."""
    hit = F.col("index") == _at(index)
    return ranked(rows, key, pos).withColumn(value_col, F.when(hit, F.lit(value)).otherwise(F.col(value_col))).drop("index", "length")


def first_with_rows(rows: DataFrame, keys: list, key: str = "key") -> Column:
    """Whether a row is of the first of the keys that has any (asked before the rows are used)."""
    there = {r[0] for r in rows.where(F.col(key).isin(keys)).select(key).distinct().collect()}  # at most as many as keys
    first = next((k for k in keys if k in there), None)
    return F.lit(False) if first is None else F.coalesce(F.col(key) == F.lit(first), F.lit(False))


def pop_first(rows: DataFrame, keys: list, count: int = 1, left: bool = True, key: str = "key", pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """LMPOP: (popped, rest) of the first of the keys that isn't empty."""
    own = first_with_rows(rows, keys, key)
    popped, rest = pop(rows.where(own), count, left, key, pos)
    return popped, rest.unionByName(rows.where(~own))
