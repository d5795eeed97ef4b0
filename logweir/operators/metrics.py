"""Gauges and counters over logs and ack state.  ``now`` is an argument, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import GROUP, SHARD
from .acks import slowest_mandatory


def queue_depth(state: DataFrame, bounds: DataFrame) -> DataFrame:
    """Messages beyond each group's committed watermark; shards without a message end at 0."""
    return state.join(bounds, SHARD, "left").select(*GROUP, (F.coalesce("next_offset", F.lit(0).cast("long")) - F.col("committed_watermark")).alias("depth"))


def oldest_unacked_age(state: DataFrame, messages: DataFrame, now: Column) -> DataFrame:
    """Age in seconds of the message at each group's committed watermark; 0 when all is acked."""
    at = messages.select(*SHARD, F.col("offset").alias("committed_watermark"), "ts")
    age = F.greatest(F.lit(0).cast("long"), F.unix_micros(now) - F.unix_micros("ts")) / 1e6
    return state.join(at, [*SHARD, "committed_watermark"], "left").select(*GROUP, F.coalesce(age, F.lit(0.0)).alias("age_seconds"))


def pruning_blocked(state: DataFrame, mandatory: Column) -> DataFrame:
    """1 for the slowest mandatory group of a shard, 0 for the others."""
    slow = slowest_mandatory(state, mandatory)
    return state.join(slow, SHARD).select(*GROUP, F.coalesce((F.col("consumer_group") == F.col("slowest")).cast("int"), F.lit(0)).alias("blocked"))


def ingest_total(messages: DataFrame, assignments: DataFrame) -> DataFrame:
    """Messages by stream and the physical group that stores them."""
    return messages.join(assignments.select(*SHARD, "group_id"), SHARD).groupBy("stream", "group_id").agg(F.count(F.lit(1)).alias("messages"))


def ack_total(acks: DataFrame) -> DataFrame:
    """Offsets in ack requests, repeats counted."""
    return acks.where(F.col("kind") != "checkpoint").groupBy(*GROUP).agg(F.sum(F.size("offsets")).cast("long").alias("acks"))


#: Upper bounds in seconds of the latency histogram.
LATENCY_BOUNDS = (0.1, 1.0, 10.0, 60.0, 3600.0, 86400.0)


def ack_latency(acked: DataFrame, messages: DataFrame) -> DataFrame:
    """Latency histogram per shard of acks ``(offset, at)`` whose message is in the log."""
    seconds = F.greatest(F.lit(0).cast("long"), F.unix_micros("at") - F.unix_micros("ts")) / 1e6
    rows = acked.join(messages.select(*SHARD, "offset", "ts"), [*SHARD, "offset"]).select(*SHARD, seconds.alias("s"))
    bounds = [F.count_if(F.col("s") <= b).alias(f"le_{i}") for i, b in enumerate(LATENCY_BOUNDS)]
    return rows.groupBy(*SHARD).agg(F.count(F.lit(1)).alias("acks"), F.sum("s").alias("seconds"), *bounds)


def replication_lag(replicas: DataFrame) -> DataFrame:
    """Entries each follower is behind; leaders are not measured."""
    return replicas.where(~F.col("is_leader")).withColumn("lag", F.greatest(F.lit(0).cast("long"), F.col("leader_commit") - F.col("commit_index")))


def forced_prune_total(pruned: DataFrame) -> DataFrame:
    return pruned.groupBy(*SHARD).agg(F.sum(F.col("max_offset") - F.col("min_offset") + 1).alias("messages"))


def dead_letter_total(forwarded: DataFrame) -> DataFrame:
    return forwarded.groupBy(*SHARD).agg(F.count(F.lit(1)).alias("messages"))


def health(replicas: DataFrame, least_free: int) -> DataFrame:
    """Ready while some group has a leader or contact and disk space is left; alive while none is stuck."""
    return replicas.agg((F.bool_or(F.col("is_leader") | F.col("has_contact")) & (F.min("free_bytes") >= least_free)).alias("ready"), (~F.bool_or("is_stuck")).alias("alive"))
