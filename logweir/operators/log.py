"""Offsets, scans and shape of message logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._ship import ensure_importable
from ..functions.scalars import message_size
from ..schema import FLUSH_BYTES, INDEX_EVERY, SHARD


def assign_offsets(rows: DataFrame, arrival: str, keys: list[str] | None = None, base: DataFrame | None = None, buckets: int = 256) -> DataFrame:
    """``rows`` with gapless ``offset`` per shard in order of the integral ``arrival``.

    Arrivals are cut into buckets: rows are numbered inside a shard's bucket and
    start at the count of the shard's earlier buckets, so that a shard that
    holds most rows is numbered by many tasks.  ``base(keys, next_offset)``
    gives where each shard goes on; shards without one start at 0.  Rows without
    an arrival come last in their shard, in no fixed order; null keys are a shard.
    """
    keys = keys or SHARD
    ends = rows.agg(F.min(arrival).alias("lo"), F.max(arrival).alias("hi")).first()
    lo, width = (ends["lo"] or 0), max(1, ((ends["hi"] or 0) - (ends["lo"] or 0)) // buckets + 1)
    cut = rows.withColumn("__bucket", F.coalesce(((F.col(arrival) - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(buckets + 1)))
    counts = cut.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(*keys, "__bucket", (F.sum("__n").over(Window.partitionBy(*keys).orderBy("__bucket")) - F.col("__n")).alias("__before"))
    if base is not None:
        held = base.select(*(F.col(k).alias(f"__b{i}") for i, k in enumerate(keys)), "next_offset")
        before = before.join(held, _alike([F.col(k) for k in keys], "__b"), "left").withColumn("__before", F.col("__before") + F.coalesce("next_offset", F.lit(0))).select(*keys, "__bucket", "__before")
    inside = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(arrival)) - 1
    starts = before.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__bucket").alias("__at"), "__before")
    out = cut.withColumn("__inside", inside).join(starts, _alike([F.col(k) for k in keys], "__k") & (F.col("__bucket") == F.col("__at")))
    return out.select(*rows.columns, (F.col("__before") + F.col("__inside")).alias("offset"))


def _alike(keys: list[Column], other: str) -> Column:
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & k.eqNullSafe(F.col(f"{other}{i}"))
    return out


def point_lookup(messages: DataFrame, offset: int | Column) -> DataFrame:
    return messages.where(F.col("offset") == offset)


def range_scan(messages: DataFrame, offset: int | Column) -> DataFrame:
    """Rows at or after ``offset`` in order; file statistics prune what lies before."""
    return messages.where(F.col("offset") >= offset).orderBy(*SHARD, "offset")


def next_offset(messages: DataFrame, floor: int = 0) -> DataFrame:
    """First free offset of each shard, at least ``floor``."""
    return messages.groupBy(*SHARD).agg(F.greatest(F.lit(floor).cast("long"), F.coalesce(F.max("offset") + 1, F.lit(0).cast("long"))).alias("next_offset"))


def appends_only(wal: DataFrame) -> DataFrame:
    return wal.where(F.col("record_type") == "Append")


def acks_only(wal: DataFrame) -> DataFrame:
    return wal.where(F.col("record_type").isin("Ack", "AckCheckpoint"))


def to_log_entry(wal: DataFrame) -> DataFrame:
    return wal.drop("record_type", "raft_term", "raft_index")


def replay_dedup(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first delivery of each keyed offset: redelivered rows go; those without an order count as last."""
    first = F.min_by(F.struct(*rows.columns), F.struct(F.col(order).isNull(), F.col(order)))  # combined where the rows are
    return rows.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(first.alias("__first")).select("__first.*")


def beyond_applied(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows not yet applied, given each shard's ``next_offset``."""
    return rows.join(state, SHARD, "left").where(F.col("offset") >= F.coalesce("next_offset", F.lit(0))).drop("next_offset")


def wal_from(wal: DataFrame, index: int) -> DataFrame:
    return wal.where(F.col("raft_index") >= index).orderBy("raft_index")


def term_at(wal: DataFrame, index: int, snapshot: tuple[int, int] | None = None) -> DataFrame:
    """Term of the record at ``index``; the snapshot's own index needs no record."""
    if snapshot and snapshot[0] == index:
        return wal.sparkSession.range(1).select(F.lit(snapshot[1]).cast("long").alias("raft_term"))
    found = wal.where(F.col("raft_index") == index).agg(F.max("raft_term").alias("t"))
    return found.select(F.when(F.col("t").isNotNull(), F.col("t")).otherwise(F.raise_error(F.lit(f"no record at index {index}"))).alias("raft_term"))


def truncate_from(wal: DataFrame, index: int) -> DataFrame:
    """The log without its uncommitted end."""
    return wal.where(F.col("raft_index") < index)


def merge_entries(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """A follower's log after an append request.

    Entries already held with the same term are skipped; at the first differing
    term the local end is dropped, and the rest is appended.
    """
    both = local.select("raft_index", F.col("raft_term").alias("mine")).join(incoming.select("raft_index", F.col("raft_term").alias("theirs")), "raft_index", "left")
    found = both.agg(F.min(F.when(F.col("mine") != F.col("theirs"), F.col("raft_index"))).alias("clash"), F.max("raft_index").alias("last")).first()
    cut = found["clash"] if found["clash"] is not None else (-1 if found["last"] is None else found["last"]) + 1
    return local.where(F.col("raft_index") < cut).unionByName(incoming.where(F.col("raft_index") >= cut))


def conflict_index(wal: DataFrame, index: int) -> DataFrame:
    """First index of the run of equal terms that ends at ``index``."""
    term = wal.where(F.col("raft_index") == index).agg(F.max("raft_term")).first()[0]
    before = F.max(F.when((F.col("raft_index") < index) & (F.col("raft_term") != term), F.col("raft_index")))
    return wal.agg(F.coalesce(before + 1, F.min("raft_index")).alias("conflict_index"))


def file_ranges(files: DataFrame, key: list[str], first: str = "first_index", last_known: Column | None = None) -> DataFrame:
    """Last index of each log file: one before the next file's first, open for the newest."""
    nxt = F.lead(first).over(Window.partitionBy(*key).orderBy(first)) - 1
    return files.withColumn("last_index", nxt if last_known is None else F.coalesce(nxt, last_known))


def live_files(files: DataFrame, snapshot_index: int | Column) -> DataFrame:
    """Files that a snapshot at ``snapshot_index`` does not cover whole; straddlers and the newest stay."""
    return files.where(F.col("last_index").isNull() | (F.col("last_index") > snapshot_index))


def with_size(messages: DataFrame) -> DataFrame:
    return messages.withColumn("bytes", message_size(F.col("partition_key"), F.col("headers"), F.col("payload")))


def segment_stats(messages: DataFrame, segment: str = "segment") -> DataFrame:
    """Range, count (``max - min + 1``) and bytes of each segment."""
    out = messages.groupBy(*SHARD, segment).agg(F.min("offset").alias("min_offset"), F.max("offset").alias("max_offset"), F.sum("bytes").alias("bytes"))
    return out.withColumn("messages", F.col("max_offset") - F.col("min_offset") + 1)


def flush_segments(messages: DataFrame, threshold: int = FLUSH_BYTES) -> DataFrame:
    """``messages(..., bytes)`` with the ``segment`` each is flushed to, per shard in offset order.

    A buffer is flushed once its bytes reach ``threshold`` and the sum restarts,
    which is sequential within a shard as its writer is; rows stream through.
    """
    schema = "stream string, vshard int, offset long, bytes long, segment long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, segment, held = None, 0, 0
        for f in frames:
            out = []
            for key, size in zip(zip(f["stream"], f["vshard"], strict=True), f["bytes"].tolist(), strict=True):
                if key != shard:
                    shard, segment, held = key, 0, 0
                out.append(segment)
                held += size
                if held >= threshold:
                    segment, held = segment + 1, 0
            yield f.assign(segment=out)

    ensure_importable(messages.sparkSession)
    rows = messages.select(*SHARD, "offset", "bytes").repartition(*SHARD).sortWithinPartitions(*SHARD, "offset")
    return rows.mapInPandas(run, schema)


def sparse_index(messages: DataFrame, segment: str = "segment", every: int = INDEX_EVERY) -> DataFrame:
    """Offset and byte position of every ``every``-th record of a segment."""
    w = Window.partitionBy(*SHARD, segment).orderBy("offset")
    out = messages.select(*SHARD, segment, "offset", (F.sum("bytes").over(w) - F.col("bytes")).alias("position"), F.row_number().over(w).alias("__r"))
    return out.where(F.col("__r") % every == 1 % every).drop("__r")


def seek(index: DataFrame, offset: int | Column, segment: str = "segment") -> DataFrame:
    """Byte position to start reading at for ``offset``: the last index entry at or before it, else the start."""
    return index.groupBy(*SHARD, segment).agg(F.coalesce(F.max_by("position", F.when(F.col("offset") <= offset, F.col("offset"))), F.lit(0).cast("long")).alias("position"))


def prune_segments(segments: DataFrame, offset: int | Column) -> DataFrame:
    """Segments that a scan from ``offset`` reads."""
    return segments.where(F.col("max_offset") >= offset)


def covering_segments(segments: DataFrame, offset: int | Column) -> DataFrame:
    """Segments that a lookup of ``offset`` reads."""
    return segments.where((F.col("min_offset") <= offset) & (F.col("max_offset") >= offset))


def segments_then_buffer(segments: DataFrame, buffer: DataFrame) -> DataFrame:
    """Flushed rows and the unflushed newest ones; the two are disjoint."""
    return segments.unionByName(buffer)


def quorum_commit(matches: DataFrame, key: list[str], members: Column, terms: DataFrame, current_term: Column) -> DataFrame:
    """Highest index of the leader's own term that a majority holds, per group of ``key``."""
    ranked = matches.groupBy(*key).agg(F.sort_array(F.collect_list("match_index"), asc=False).alias("m"), F.first(members).alias("n"))  # one entry per member
    held = ranked.select(*key, F.get("m", F.floor(F.col("n") / 2).cast("int")).alias("majority"))
    own = terms.where(F.col("raft_term") == current_term)
    return held.join(own, key).where(F.col("raft_index") <= F.col("majority")).groupBy(*key).agg(F.max("raft_index").alias("commit_index"))
