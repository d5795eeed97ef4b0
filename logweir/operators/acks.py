"""Acknowledgement state of consumer groups.  Watermarks are exclusive ends."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._ship import ensure_importable
from ..schema import ACK_STATE, GROUP, SHARD


def explode_acks(acks: DataFrame) -> DataFrame:
    return acks.where(F.col("kind") != "checkpoint").select(*GROUP, "kind", F.explode("offsets").alias("offset"))


def low_watermark(acked: DataFrame, registered: DataFrame | None = None, keys: list[str] | None = None, name: str = "low_watermark") -> DataFrame:
    """End of each group's contiguous acked prefix, from one row per acked offset.

    The end is the least ``o + 1`` that is not acked with ``o`` acked, or 0 where
    0 itself is not.  That is an anti-join on the group and the offset, so the
    offsets of the largest group are spread over all tasks.  ``registered``
    groups without any ack have 0.
    """
    keys = keys or GROUP
    held = acked.select(*keys, "offset").distinct()
    after = held.select(*keys, (F.col("offset") + 1).alias("offset"))
    ends = after.join(held, [*keys, "offset"], "left_anti").groupBy(*keys).agg(F.min("offset").alias("end"))
    zero = held.where(F.col("offset") == 0).select(*keys, F.lit(True).alias("zero"))
    out = ends.join(zero, keys, "left").select(*keys, F.when(F.col("zero"), F.col("end")).otherwise(F.lit(0).cast("long")).alias(name))
    if registered is not None:
        out = registered.select(*keys).distinct().join(out, keys, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


def selective(acked: DataFrame, watermarks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Acked offsets at or beyond their group's watermark."""
    keys = keys or GROUP
    return acked.select(*keys, "offset").distinct().join(watermarks, keys).where(F.col("offset") >= F.col("low_watermark")).drop("low_watermark")


def is_acked(messages: DataFrame, acked: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Each message for each group, with ``acked``."""
    held = acked.select(*GROUP, "offset").distinct().withColumn("__held", F.lit(True))
    rows = messages.join(watermarks, SHARD).join(held, [*GROUP, "offset"], "left")
    return rows.withColumn("acked", (F.col("offset") < F.col("low_watermark")) | F.coalesce("__held", F.lit(False))).drop("__held", "low_watermark")


def within_log_bounds(acked: DataFrame, bounds: DataFrame) -> DataFrame:
    """Acks of offsets that exist; checkpoint-mode requests are held to this."""
    return acked.join(bounds, SHARD).where(F.col("offset") < F.col("next_offset")).drop("next_offset")


def registered_groups(acks: DataFrame, opened: DataFrame | None = None) -> DataFrame:
    """Groups that acked, and those that only opened a consumer."""
    out = acks.select(*GROUP).distinct()
    return out if opened is None else out.union(opened.select(*GROUP)).distinct()


def all_groups_watermark(state: DataFrame, shards: DataFrame | None = None) -> DataFrame:
    """Least applied watermark per shard; 0 for shards without a group."""
    out = state.groupBy(*SHARD).agg(F.min("low_watermark").alias("watermark"))
    return _of_shards(out, shards)


def mandatory_watermark(state: DataFrame, mandatory: Column, shards: DataFrame | None = None) -> DataFrame:
    """Least committed watermark of mandatory groups per shard; 0 without one: nothing may be pruned."""
    out = state.groupBy(*SHARD).agg(F.coalesce(F.min(F.when(mandatory, F.col("committed_watermark"))), F.lit(0).cast("long")).alias("watermark"))
    return _of_shards(out, shards)


def _of_shards(out: DataFrame, shards: DataFrame | None) -> DataFrame:
    if shards is None:
        return out
    return shards.select(*SHARD).distinct().join(out, SHARD, "left").withColumn("watermark", F.coalesce("watermark", F.lit(0).cast("long")))


def slowest_mandatory(state: DataFrame, mandatory: Column) -> DataFrame:
    """The mandatory group with the least committed watermark per shard; the first by name of equal ones."""
    order = F.when(mandatory, F.struct("committed_watermark", "consumer_group"))
    return state.groupBy(*SHARD).agg(F.min(order)["consumer_group"].alias("slowest"))


class AckState:
    """Ack progress of one group in event order: the exact state machine."""

    def __init__(self, low: int = 0, committed: int = 0, selective: list[int] | None = None, committed_selective: list[int] | None = None):
        self.low, self.committed = low, committed
        self.selective, self.committed_selective = set(selective or ()), set(committed_selective or ())

    def ack(self, offsets: list[int]) -> None:
        """A committed ack: moves the applied and the committed side."""
        self.local(offsets)
        self.committed_selective.update(o for o in offsets if o >= self.committed)
        while self.committed in self.committed_selective:
            self.committed_selective.discard(self.committed)
            self.committed += 1

    def local(self, offsets: list[int]) -> None:
        """An ack applied where it was received, not committed yet."""
        self.selective.update(o for o in offsets if o >= self.low)
        while self.low in self.selective:
            self.selective.discard(self.low)
            self.low += 1

    def checkpoint(self, watermark: int) -> None:
        """A replicated watermark.  It never moves back, and does not run on into selective acks: the next ack does."""
        if watermark <= self.committed:
            return
        self.committed = watermark
        self.committed_selective = {o for o in self.committed_selective if o >= watermark}
        if watermark > self.low:
            self.low = watermark
            self.selective = {o for o in self.selective if o >= watermark}

    def apply(self, kind: str, offsets: list[int] | None, watermark: int | None) -> None:
        if kind == "checkpoint":
            self.checkpoint(int(watermark))
        else:
            {"ack": self.ack, "local": self.local}[kind]([int(o) for o in (() if offsets is None else offsets)])

    def row(self) -> tuple[int, int, list[int], list[int]]:
        return self.low, self.committed, sorted(self.selective), sorted(self.committed_selective)


def fold_acks(acks: DataFrame) -> DataFrame:
    """``ack_state`` of each group from its events in ``seq`` order, exact for any mix of kinds.

    The state machine is inherently sequential within a group; logs of plain
    acks are better served by ``low_watermark``.
    """

    def fold(key: tuple, events: pd.DataFrame) -> pd.DataFrame:
        state = AckState()
        for e in events.sort_values("seq").itertuples():
            state.apply(e.kind, e.offsets, e.watermark)
        return pd.DataFrame([(*key, *state.row())], columns=ACK_STATE.names)

    ensure_importable(acks.sparkSession)
    return acks.groupBy(*GROUP).applyInPandas(fold, ACK_STATE)


