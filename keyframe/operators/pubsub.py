"""Published messages (channel, payload, ts), in batches or streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import glob_to_regex


def subscribed(messages: DataFrame, channels: list[str] = (), patterns: list[str] = ()) -> DataFrame:
    """SUBSCRIBE, PSUBSCRIBE: messages on any of the channels or patterns; works on a stream as well."""
    test = F.col("channel").isin(list(channels)) if channels else F.lit(False)
    for p in patterns:
        test = test | F.col("channel").rlike(glob_to_regex(p))
    return messages.where(test)


def channel_counts(messages: DataFrame) -> DataFrame:
    """PUBSUB CHANNELS, NUMSUB: messages of each channel."""
    return messages.groupBy("channel").agg(F.count("*").alias("n"))


def shard(channel: Column, shards: int) -> Column:
    """The shard of a channel: SPUBLISH and SSUBSCRIBE meet there."""
    return F.conv(F.substring(F.md5(channel), 1, 8), 16, 10).cast("long") % shards


def sharded(messages: DataFrame, channels: list[str], shards: int) -> DataFrame:
    """SPUBLISH and SSUBSCRIBE: the messages of the channels asked for, with their shard, dealt by it. Works on streams too."""
    rows = messages.where(F.col("channel").isin(channels)).withColumn("shard", shard(F.col("channel"), shards))
    return rows if messages.isStreaming else rows.repartition("shard")
