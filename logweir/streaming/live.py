"""Structured Streaming forms: publishing, tailing, ack state and checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .._ship import ensure_importable
from ..operators.acks import AckState
from ..schema import ACK_STATE, ACKS, CHECKPOINT_INTERVAL_US, GROUP, MESSAGES, SHARD
from ..sources import tables


class AckProcessor(StatefulProcessor):
    """The ack state machine of one consumer group as streaming state.

    Acks of a micro-batch are applied in ``seq`` order; redelivered events
    (``seq`` at or below the last applied) are skipped.  The selective sets only
    hold offsets beyond their watermark, so state stays as small as the gaps.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marks = handle.getValueState("marks", "low long, committed long, seq long")
        self.sets = handle.getValueState("sets", "selective array<long>, committed_selective array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        low, committed, last = self.marks.get() if self.marks.exists() else (0, 0, -1)
        held, kept = self.sets.get() if self.sets.exists() else ([], [])
        state = AckState(low, committed, list(held), list(kept))
        events = pd.concat(list(rows)).sort_values("seq")
        for e in events[events["seq"] > last].itertuples():
            state.apply(e.kind, e.offsets, e.watermark)
            last = int(e.seq)
        low, committed, a, b = state.row()
        self.marks.update((low, committed, last))
        self.sets.update((a, b))
        yield pd.DataFrame([(*key, low, committed, a, b)], columns=ACK_STATE.names)

    def close(self) -> None:
        pass


def ack_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(ACKS).parquet(path)


def ack_state_stream(acks: DataFrame) -> DataFrame:
    """Ack state per group, updated with every micro-batch.  Needs the RocksDB state store."""
    ensure_importable(acks.sparkSession)
    return acks.groupBy(*GROUP).transformWithStateInPandas(statefulProcessor=AckProcessor(), outputStructType=ACK_STATE, outputMode="Update", timeMode="None")


def publish_stream(rows: DataFrame, streams: DataFrame, path: str, checkpoint: str, arrival: str = "seq") -> StreamingQuery:
    """Append a stream of publish requests; a batch that is run again overwrites its own folder."""

    def sink(batch: DataFrame, n: int) -> None:
        tables.publish(batch, streams, path, arrival, batch=n)

    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def consume(messages: DataFrame, state: DataFrame, group: str, skip_selective: bool = False) -> DataFrame:
    """Messages from a group's low watermark on; a group without state starts at 0.

    Selectively acked messages come again, as the protocol has it;
    ``skip_selective`` leaves them out.
    """
    own = state.where(F.col("consumer_group") == group).select(*SHARD, "low_watermark", *(["selective"] if skip_selective else []))
    out = messages.join(own, SHARD, "left").where(F.col("offset") >= F.coalesce("low_watermark", F.lit(0)))
    if skip_selective:
        out = out.where(~F.coalesce(F.array_contains("selective", F.col("offset")), F.lit(False))).drop("selective")
    return out.drop("low_watermark")


def consume_stream(spark: SparkSession, path: str, state: Callable[[], DataFrame], group: str, handle: Callable[[DataFrame, int], None], checkpoint: str, live: bool = False) -> StreamingQuery:
    """Tail the log for ``group``; ``handle`` gets each batch at least once."""
    source = spark.readStream.schema(MESSAGES).option("recursiveFileLookup", "false").parquet(path)

    def sink(batch: DataFrame, n: int) -> None:
        handle(consume(batch, state(), group), n)

    writer = source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime="1 second") if live else writer.trigger(availableNow=True)).start()


class CheckpointProcessor(StatefulProcessor):
    """Proposes a group's watermark when enough offsets or time went by since the last proposal.

    With ``ticking`` a group that falls silent reaches its interval, too: a timer
    proposes the newest watermark once the interval has passed.
    """

    def __init__(self, interval_us: int | None = None, count: int | None = None, ticking: bool = False):
        self.interval = interval_us if interval_us is not None else (CHECKPOINT_INTERVAL_US if count is None else None)
        self.count, self.ticking = count, ticking and self.interval is not None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "mark long, at long")
        self.seen = handle.getValueState("seen", "mark long, at long")

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*GROUP, "watermark", "at_us"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        mark, at = self.last.get() if self.last.exists() else (0, None)
        out, newest = [], self.seen.get() if self.seen.exists() else (0, 0)
        for e in pd.concat(list(rows)).sort_values("at_us").itertuples():
            gained = int(e.low_watermark) - mark
            newest = max(newest, (int(e.low_watermark), int(e.at_us)))
            due = gained > 0 and ((self.count is not None and gained >= self.count) or (self.interval is not None and (at is None or int(e.at_us) - at >= self.interval)))
            if due:
                mark, at = int(e.low_watermark), int(e.at_us)
                out.append((*key, mark, at))
        if out:
            self.last.update((mark, at))
        self.seen.update(newest)
        if self.ticking and newest[0] > mark:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + max(1, self.interval // 1000))
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, at = self.last.get() if self.last.exists() else (0, None)
        newest, now = self.seen.get()[0] if self.seen.exists() else 0, expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = newest > mark and (at is None or now - at >= self.interval)
        if due:
            self.last.update((newest, now))
        yield self._frame([(*key, newest, now)] if due else [])

    def close(self) -> None:
        pass


def checkpoint_stream(progress: DataFrame, interval_us: int | None = None, count: int | None = None, ticking: bool = False) -> DataFrame:
    """Checkpoint proposals from a stream of ``(group, low_watermark, at_us)``; ``ticking`` ones by the processing time, too."""
    schema = "stream string, vshard int, consumer_group string, watermark long, at_us long"
    ensure_importable(progress.sparkSession)
    processor = CheckpointProcessor(interval_us, count, ticking)
    return progress.groupBy(*GROUP).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if processor.ticking else "None")
