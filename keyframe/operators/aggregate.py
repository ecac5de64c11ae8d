"""The aggregation pipeline: FILTER, GROUPBY with reducers, APPLY, SORTBY, LIMIT, LOAD in the order written.

Each step adds to one lazy DataFrame; expressions are Spark SQL text. Reducers take
numbers only (other values don't count), a missing group value is the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import number

Reducer = tuple[str, str | None, str]


class Pipeline:
    """A chain of steps over hits; each returns a new pipeline."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows

    def load(self, *fields: str) -> Pipeline:
        return Pipeline(self.rows.select(*fields))

    def where(self, test: str | Column) -> Pipeline:
        return Pipeline(self.rows.where(test))

    def group_by(self, keys: list[str], *reducers: Reducer) -> Pipeline:
        """reducers: (count | sum | avg | min | max | count_distinct, field, alias). No keys: one row, or none for no rows."""
        fold = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
        made = []
        for kind, field, alias in reducers:
            if kind == "count":
                made.append(F.count("*").alias(alias))
            elif kind == "count_distinct":
                made.append(F.count_distinct(field).alias(alias))
            else:
                made.append(F.coalesce(fold[kind](number(F.col(field))), F.lit(0.0)).alias(alias))
        if not keys:
            return Pipeline(self.rows.groupBy(F.lit(0).alias("_all")).agg(*made).drop("_all"))
        named = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) if dict(self.rows.dtypes)[k] == "string" else F.col(k) for k in keys]
        return Pipeline(self.rows.groupBy(*named).agg(*made))

    def apply(self, expression: str, alias: str) -> Pipeline:
        """A SQL expression of the columns at hand; use try_divide where a divisor may be 0."""
        return Pipeline(self.rows.withColumn(alias, F.expr(expression)))

    def sort_by(self, *order: tuple[str, bool], limit: int | None = None, offset: int = 0) -> Pipeline:
        """order: (field, descending); ties are the caller's to break. With a limit Spark keeps the top rows only."""
        rows = self.rows.orderBy(*(F.col(f).desc() if down else F.col(f).asc() for f, down in order))
        return Pipeline((rows.offset(offset) if offset else rows).limit(limit) if limit is not None else rows)
