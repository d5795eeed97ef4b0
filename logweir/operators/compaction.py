"""Segment compaction planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import scan
from ..schema import CHECKPOINT_INTERVAL_US, GROUP, SHARD


def candidates(segments: DataFrame, now: Column, least_age_us: int | None) -> DataFrame:
    """Segments old enough to compact; all without a limit."""
    return segments if least_age_us is None else segments.where(F.unix_micros(now) - F.unix_micros("written_at") >= least_age_us)


def merge_groups(segments: DataFrame, most_bytes: int | None) -> DataFrame:
    """Greedy packing by ascending offset: a segment that would overfill its group opens the next.

    The sum restarts with each group, so this is a fold over a shard's segment
    catalogue (rows are files, not messages).  Without a limit all share group 0.
    """
    row, limit = "struct<min_offset:bigint,max_offset:bigint,bytes:bigint,merge_group:int>", F.lit(most_bytes).cast("long")

    def step(state: Column, s: Column) -> tuple[dict[str, Column], Column]:
        full = F.coalesce((state["members"] > 0) & (state["held"] + s["bytes"] > limit), F.lit(False))
        group = state["group"] + full.cast("int")
        after = {"group": group, "held": F.when(full, s["bytes"]).otherwise(state["held"] + s["bytes"]), "members": F.lit(1)}
        return after, F.struct(s["min_offset"].alias("min_offset"), s["max_offset"].alias("max_offset"), s["bytes"].alias("bytes"), group.alias("merge_group"))

    start = {"group": F.lit(0), "held": F.lit(0).cast("long"), "members": F.lit(0)}
    listed = segments.groupBy(*SHARD).agg(F.array_sort(F.collect_list(F.struct("min_offset", "max_offset", "bytes"))).alias("s"))  # files, not messages
    return listed.select(*SHARD, F.inline(scan(F.col("s"), start, step, row)))


def first_plan(groups: DataFrame) -> DataFrame:
    """Members of each shard's first group of two or more segments."""
    sizes = groups.groupBy(*SHARD, "merge_group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
    first = sizes.groupBy(*SHARD).agg(F.min("merge_group").alias("merge_group"))
    return groups.join(first, [*SHARD, "merge_group"], "left_semi")


def replace_in(segments: DataFrame, sources: DataFrame, merged: DataFrame) -> DataFrame:
    """The catalogue with ``sources`` replaced by ``merged``, by offset."""
    kept = segments.join(sources, [*SHARD, "min_offset", "max_offset"], "left_anti")
    return kept.unionByName(merged).orderBy(*SHARD, "min_offset")


def merged_segments(plan: DataFrame) -> DataFrame:
    """One segment for each planned group."""
    return plan.groupBy(*SHARD, "merge_group").agg(F.min("min_offset").alias("min_offset"), F.max("max_offset").alias("max_offset"), F.sum("bytes").alias("bytes"))


def stale_plans(sources: DataFrame, segments: DataFrame) -> DataFrame:
    """Shards whose plan lost a source meanwhile: their result is discarded."""
    return sources.join(segments, [*SHARD, "min_offset", "max_offset"], "left_anti").select(*SHARD).distinct()


def checkpoint_due(progress: DataFrame, interval_us: int | None = None, count: int | None = None) -> DataFrame:
    """Which observations ``(seq, at, low_watermark)`` of a group propose a checkpoint.

    Due if the watermark advanced past the last proposed one and either enough
    offsets or enough time went by; the first advance is always due by time.
    Only without both limits the default interval holds.
    """
    effective = interval_us if interval_us is not None else (CHECKPOINT_INTERVAL_US if count is None else None)
    row = "struct<seq:bigint,low_watermark:bigint,due:boolean>"

    def step(state: Column, e: Column) -> tuple[dict[str, Column], Column]:
        gained = e["low_watermark"] - state["mark"]
        by_count = F.lit(False) if count is None else gained >= count
        by_time = F.lit(False) if effective is None else F.coalesce(e["us"] - state["us"] >= effective, F.lit(True))
        due = (gained > 0) & (by_count | by_time)
        after = {"mark": F.when(due, e["low_watermark"]).otherwise(state["mark"]), "us": F.when(due, e["us"]).otherwise(state["us"])}
        return after, F.struct(e["seq"].alias("seq"), e["low_watermark"].alias("low_watermark"), due.alias("due"))

    start = {"mark": F.lit(0).cast("long"), "us": F.lit(None).cast("long")}
    listed = progress.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("seq", F.unix_micros("at").alias("us"), "low_watermark"))).alias("e"))
    return listed.select(*GROUP, F.inline(scan(F.col("e"), start, step, row)))
