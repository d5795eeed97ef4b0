"""What may be pruned, what must be forwarded to the dead-letter stream, and reshard copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dead_letter_name, retention_cutoff
from ..schema import SHARD
from .log import assign_offsets, next_offset


def prunable_segments(segments: DataFrame, gates: DataFrame) -> DataFrame:
    """Segments wholly below their shard's ``watermark``; straddlers are kept."""
    return segments.join(gates, SHARD).where(F.col("max_offset") < F.col("watermark"))


def past_retention(messages: DataFrame, now: Column, max_us: Column) -> DataFrame:
    """Each message with ``expired``: at or before the cutoff, in whole milliseconds."""
    return messages.withColumn("expired", F.timestamp_millis(F.floor(F.unix_micros("ts") / 1000)) <= retention_cutoff(now, max_us))


def retention_stops(messages: DataFrame, gates: DataFrame, now: Column, max_us: Column, forwarding: Column | None = None) -> DataFrame:
    """Where each shard's retention walk ends: the first message at or beyond the mandatory
    ``watermark`` that is too young, or that cannot be forwarded (``forwarding`` false).

    Also the walk's start ``safe`` and the log's end, so that callers need no second scan.
    Every shard of ``gates`` has a row; one without a message from ``safe`` on has neither stop nor end.
    """
    blocked = ~F.col("expired") if forwarding is None else (~F.col("expired") | ~forwarding)
    rows = past_retention(messages, now, max_us).join(gates, SHARD)
    seen = rows.where(F.col("offset") >= F.col("safe"))
    stops = seen.groupBy(*SHARD).agg(F.min(F.when((F.col("offset") >= F.col("watermark")) & blocked, F.col("offset"))).alias("stop"), (F.max("offset") + 1).alias("end"))
    return gates.select(*SHARD, "watermark", "safe").join(stops, SHARD, "left")


def safe_to_prune(stops: DataFrame) -> DataFrame:
    return stops.select(*SHARD, F.coalesce("stop", "end", "safe").alias("safe_to_prune"))


def dead_letters(messages: DataFrame, stops: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    """Expired messages that mandatory groups have not acked, renamed to their dead-letter stream.

    With ``streams`` given, those whose dead-letter stream is not provisioned are left out.
    """
    due = messages.join(stops, SHARD).where((F.col("offset") >= F.greatest("safe", "watermark")) & (F.col("offset") < F.coalesce("stop", "end")))
    out = due.drop("watermark", "safe", "stop", "end").withColumn("stream", dead_letter_name(F.col("stream")))
    return out if streams is None else out.join(streams.select("stream"), "stream", "left_semi")


def audit_kept(segments: DataFrame, now: Column, audit_us: Column, enforce_audit: bool = False) -> DataFrame:
    """Optionally keep segments inside the audit period, which is stored but never enforced by default."""
    return segments if not enforce_audit else segments.where(F.unix_micros(now) - F.unix_micros("written_at") >= audit_us)


def size_floor_prune(segments: DataFrame, most_bytes: int | None, readable: Column | None = None) -> DataFrame:
    """Oldest segments to delete until a shard is at or under ``most_bytes``.

    Unreadable segments stay and free nothing.  No limit deletes nothing.
    Acks are ignored on purpose.
    """
    if most_bytes is None:
        return segments.limit(0)
    ok = F.lit(True) if readable is None else readable
    freed = F.sum(F.when(ok, F.col("bytes")).otherwise(0)).over(Window.partitionBy(*SHARD).orderBy("min_offset").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("bytes").over(Window.partitionBy(*SHARD))
    out = segments.withColumn("__left", total - F.coalesce(freed, F.lit(0)))
    return out.where((F.col("__left") > most_bytes) & ok).drop("__left")


def reshard_copy(source: DataFrame, from_offset: int, target: DataFrame, stream: str, vshard: int, now: Column) -> DataFrame:
    """Source rows at or after ``from_offset`` as the target stores them: new offsets, new timestamps.

    The whole group's log is copied, and no ack state.
    """
    base = next_offset(target)
    rows = source.where(F.col("offset") >= from_offset).withColumnRenamed("offset", "source_offset")
    rows = rows.withColumns({"stream": F.lit(stream), "vshard": F.lit(vshard), "ts": now})
    return assign_offsets(rows, "source_offset", SHARD, base)


def reshard_progress(source: DataFrame, from_offset: int) -> DataFrame:
    """Where the next copy round starts, and whether this one found nothing."""
    last = source.where(F.col("offset") >= from_offset).agg(F.max("offset").alias("m"))
    nxt = F.coalesce(F.col("m") + 1, F.lit(from_offset).cast("long"))
    return last.select(nxt.alias("next_offset"), (nxt == from_offset).alias("caught_up"))


def admitted(rows: DataFrame, paused: DataFrame, key: str = "group_id") -> DataFrame:
    """Rows of groups that are not paused for a migration."""
    return rows.join(paused.select(key), key, "left_anti")
