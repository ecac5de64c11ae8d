"""First rows of windows: a fold in the order of time that no window function can say."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def opens_window(rows: DataFrame, keys: list[str], ts: str, span_ms: int, out: str, *ties: str) -> DataFrame:
    """rows with `out`: whether each, in the order of (ts, ties), comes span_ms or more after the last row of its keys that did.

    A task holds one batch and the end of one key's window. A null ts gives null and opens nothing.
    """

    def step(until: int | None, t: int | None) -> tuple[int | None, tuple]:
        opens = None if t is None else until is None or t >= until
        return (t + span_ms if opens else until), (opens,)

    return folded(rows, keys, [ts, *ties], [ts], step, [T.StructField(out, T.BooleanType())])


def folded(rows: DataFrame, keys: list[str], order: list[str], args: list[str], step: Callable, out: list[T.StructField]) -> DataFrame:
    """rows with the columns `out` of a fold over each key's rows in order: step(state or None, *args) gives the new state and a row's values.

    A key's rows go to one task, which holds a batch of them and the state.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in (*keys, *args)]
            for values in zip(*columns, strict=True):
                key = values[: len(keys)]
                if key != held:
                    held, state = key, None
                state, made = step(state, *values[len(keys) :])
                found.append(made)
            new = [pa.array([f[i] for f in found], from_spark[i]) for i in range(len(out))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(f.name for f in out)])

    from_spark = [to_arrow_type(f.dataType) for f in out]
    schema = T.StructType([*rows.schema.fields, *out])
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(fold, schema)
