"""A segmented log: rows in runs, and a versioned catalogue of the live segments.

Rows are only ever added.  What is live stands in the newest version of the
catalogue, so a reader sees a compaction or a pruning whole or not at all, and a
job that fails leaves files that no catalogue names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compaction, retention
from ..operators.log import with_size
from ..schema import MESSAGES, SHARD
from .tables import read

KIND = "stream string, vshard int, min_offset long, max_offset long, bytes long, written_at timestamp, run string"


class SegmentTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _version(self) -> int:
        last = read(self.spark, f"{self.path}/catalogue", KIND + ", version long").agg(F.max("version")).first()[0]
        return -1 if last is None else last

    def catalogue(self) -> DataFrame:
        """The live segments, one row for each."""
        return read(self.spark, f"{self.path}/catalogue", KIND + ", version long").where(F.col("version") == self._version()).drop("version")

    def _commit(self, segments: DataFrame, seen: int) -> None:
        """Make ``segments`` the live ones; raises if another job came first."""
        segments.write.mode("errorifexists").parquet(f"{self.path}/catalogue/version={seen + 1}")

    def rows(self) -> DataFrame:
        """The rows of all live segments."""
        every = read(self.spark, f"{self.path}/rows", self._kind())
        return every.join(self.catalogue().select(*SHARD, "run"), [*SHARD, "run"], "left_semi").select(*MESSAGES.names)

    @staticmethod
    def _kind() -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in MESSAGES.fields) + ", run string"

    def _write(self, rows: DataFrame, now: Column) -> DataFrame:
        """Write a run, and its segments: one a shard, in offset order."""
        run = uuid.uuid4().hex
        rows.select(*MESSAGES.names).repartition(*SHARD).sortWithinPartitions(*SHARD, "offset").write.partitionBy(*SHARD).parquet(f"{self.path}/rows/run={run}")
        written = with_size(read(self.spark, f"{self.path}/rows", self._kind()).where(F.col("run") == run))
        bounds = [F.min("offset").alias("min_offset"), F.max("offset").alias("max_offset"), F.sum("bytes").alias("bytes")]
        return written.groupBy(*SHARD).agg(*bounds).select("*", now.alias("written_at"), F.lit(run).alias("run"))

    def append(self, rows: DataFrame, now: Column) -> None:
        """Flush ``rows``, which lie beyond the live ones, as new segments."""
        seen = self._version()
        self._commit(self.catalogue().unionByName(self._write(rows, now)), seen)

    def compact(self, now: Column, most_bytes: int | None, least_age_us: int | None = None, meanwhile: Callable[[], None] = lambda: None) -> int:
        """Merge each shard's first mergeable group and return how many segments that replaced.

        The merged rows are written before the catalogue is read again.  Shards of
        which a source was pruned or merged ``meanwhile`` keep what they have then.
        """
        listed = self.catalogue()
        old = compaction.candidates(listed, now, least_age_us)
        key = [*SHARD, "min_offset", "max_offset"]
        plan = compaction.first_plan(compaction.merge_groups(old, most_bytes)).join(listed.select(*key, "run"), key)
        if plan.isEmpty():
            return 0
        every = read(self.spark, f"{self.path}/rows", self._kind())
        merged = self._write(every.join(plan.select(*SHARD, "run"), [*SHARD, "run"], "left_semi"), now)
        meanwhile()
        seen, live = self._version(), self.catalogue()
        stale = compaction.stale_plans(plan.select(*key), live)
        sound, done = plan.join(stale, SHARD, "left_anti"), merged.join(stale, SHARD, "left_anti")
        n = sound.count()
        if n:
            self._commit(live.join(sound.select(*key), key, "left_anti").unionByName(done), seen)
        return n

    def _drop(self, gone: DataFrame, seen: int) -> int:
        key = [*SHARD, "min_offset", "max_offset"]
        n = gone.count()
        if n:
            self._commit(self.catalogue().join(gone.select(*key), key, "left_anti"), seen)
        return n

    def prune(self, gates: DataFrame) -> int:
        """Drop segments wholly below their shard's ``watermark``; returns how many."""
        seen = self._version()
        return self._drop(retention.prunable_segments(self.catalogue(), gates), seen)

    def size_prune(self, most_bytes: int | None, paused: DataFrame | None = None) -> int:
        """Drop the oldest segments of shards over ``most_bytes``; shards that are ``paused`` for a migration stay."""
        seen, live = self._version(), self.catalogue()
        free = live if paused is None else live.join(paused.select(*SHARD), SHARD, "left_anti")
        return self._drop(retention.size_floor_prune(free, most_bytes), seen)
