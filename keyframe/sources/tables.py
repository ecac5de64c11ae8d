"""Tables, snapshots and the mutation log.

A store's state is a table per type; its history is an append-only mutation log with
the columns key, seq, op ('set' or 'del'), value, expire_at. Compaction keeps the latest
row of each key, by `max_by` with map-side combining, so a hot key isn't sorted.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder; filters and columns are pushed into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def compact(log: DataFrame, keys: list[str], seq: str = "seq", op: str | None = "op") -> DataFrame:
    """The live rows of a mutation log: the last of each key, unless it deletes."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_last")).select(*keys, *(f"_last.{c}" for c in rest))
    return last.where(F.col(op) != "del") if op else last


def append(log: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append rows to the mutation log."""
    writer = log.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def save_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Write each typed table under path: a point-in-time snapshot, as DataFrames don't change."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_snapshot(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def replay(spark: SparkSession, path: str, schema: str, fold: Callable[[DataFrame, int], None], checkpoint: str):
    """Follow the mutation log as a stream, a micro-batch at a time; stops when what is there is read."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live(df: DataFrame, as_of_ms: int, expire_col: str = "expire_at") -> DataFrame:
    """Rows that haven't expired at a given time (ms); no expiry is null."""
    return df.where(F.col(expire_col).isNull() | (F.col(expire_col) > as_of_ms))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: spark.checkpoint.dir. Where it is unset, a local folder, if all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='keyframe-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")
