"""The log's tables in a folder: partitioned appends with gapless offsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .._ship import ensure_importable
from ..functions.hashing import route_xxh3
from ..functions.scalars import CORRELATION, default_header, group_error
from ..operators.log import assign_offsets, next_offset
from ..operators.policy import with_group_policy
from ..operators.retention import dead_letters, reshard_copy, reshard_progress
from ..schema import ACKS, MESSAGES, META_LOG, SHARD


def read(spark: SparkSession, path: str, schema=MESSAGES) -> DataFrame:
    """The table, empty while nothing was written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # an absent folder is an empty log
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def route(rows: DataFrame, streams: DataFrame) -> DataFrame:
    """``rows`` with their virtual shard, by their stream's shard count."""
    ensure_importable(rows.sparkSession)
    return rows.join(streams.select("stream", "vshards"), "stream").withColumn("vshard", route_xxh3("partition_key", "vshards")).drop("vshards")


def publish(rows: DataFrame, streams: DataFrame, path: str, arrival: str = "seq", batch: int | None = None) -> DataFrame:
    """Append ``rows(stream, partition_key, headers, payload, ts, <arrival>)`` and return them with shard and offset.

    A folder per batch makes a repeated batch overwrite itself.
    """
    spark = rows.sparkSession
    held = read(spark, path)
    if batch is not None and "batch" in held.columns:
        held = held.where(F.col("batch") != batch)
    ready = rows.withColumn("headers", default_header(F.col("headers"), CORRELATION, F.encode(F.expr("uuid()"), "UTF-8"))) if "headers" in rows.columns else rows
    out = assign_offsets(route(ready, streams), arrival, SHARD, next_offset(held))
    out = out.withColumn("ts", F.timestamp_millis(F.floor(F.unix_micros("ts") / 1000))).select(*MESSAGES.names)
    where = path if batch is None else f"{path}/batch={batch}"
    # offsets ascend inside each file, so that row-group statistics prune scans
    out.repartition(*SHARD).sortWithinPartitions(*SHARD, "offset").write.mode("append" if batch is None else "overwrite").partitionBy(*SHARD).parquet(where)
    written = spark.read.schema(MESSAGES).parquet(where)
    return written


def snapshot_files(messages: DataFrame, up_to: int) -> list[str]:
    """Files that hold every committed row below ``up_to``."""
    return sorted(messages.where(F.col("offset") < up_to).inputFiles())


def install_snapshot(rows: DataFrame, path: str) -> DataFrame:
    """Replace the whole log by ``rows``, which must not be read from ``path`` itself."""
    rows.select(*MESSAGES.names).repartition(*SHARD).sortWithinPartitions(*SHARD, "offset").write.mode("overwrite").partitionBy(*SHARD).parquet(path)
    return read(rows.sparkSession, path)


def copy_until_caught_up(source: Callable[[], DataFrame], path: str, stream: str, vshard: int, now: Column, start: int = 0) -> int:
    """Copy a group's log to a target in rounds until a round finds nothing; returns the next offset to copy from.

    ``source`` is asked anew each round, so rows that arrive meanwhile are copied too.
    """
    at = start
    while True:
        rows = source()
        step = reshard_progress(rows, at).first()
        if step["caught_up"]:
            return at
        spark = rows.sparkSession
        batch = reshard_copy(rows.where(F.col("offset") < step["next_offset"]), at, read(spark, path), stream, vshard, now)
        batch.select(*MESSAGES.names).sortWithinPartitions("offset").write.mode("append").partitionBy(*SHARD).parquet(path)
        at = step["next_offset"]


def acknowledge(requests: DataFrame, policies: DataFrame, log_path: str, path: str, batch: int | None = None) -> DataFrame:
    """Append ack requests ``(seq, stream, vshard, consumer_group, offsets)`` and return those refused, with their ``error``.

    Requests of strict groups become committed acks.  Those of checkpoint groups
    are applied where they are received, so they become local ones, without
    offsets that the log does not have.  A batch that is run again overwrites its
    own folder.
    """
    spark = requests.sparkSession
    rows = with_group_policy(requests, policies).withColumn("error", group_error(F.col("consumer_group")))
    ends = next_offset(read(spark, log_path))
    known = rows.where("error IS NULL").join(ends, SHARD, "left")
    inside = F.filter("offsets", lambda o: o < F.coalesce("next_offset", F.lit(0)))
    strict = F.col("mode") == "Strict"
    out = known.withColumns({"kind": F.when(strict, "ack").otherwise("local"), "offsets": F.when(strict, F.col("offsets")).otherwise(inside), "watermark": F.lit(None).cast("long")})
    _append(out.where(F.size("offsets") > 0).select(*ACKS.names), path, batch)
    return rows.where("error IS NOT NULL").select(*requests.columns, "error")


def checkpoint(proposals: DataFrame, path: str, batch: int | None = None) -> None:
    """Append checkpoint proposals ``(seq, stream, vshard, consumer_group, watermark)`` to the ack log."""
    rows = proposals.withColumns({"kind": F.lit("checkpoint"), "offsets": F.lit(None).cast("array<bigint>")})
    _append(rows.select(*ACKS.names), path, batch)


def _append(rows: DataFrame, path: str, batch: int | None) -> None:
    rows.write.mode("append" if batch is None else "overwrite").parquet(path if batch is None else f"{path}/batch={batch}")


def forward_dead_letters(messages: DataFrame, stops: DataFrame, streams: DataFrame, path: str, batch: int | None = None) -> DataFrame:
    """Publish what retention forwards to the dead-letter streams: routed again by key and numbered there.

    ``streams(stream, vshards)`` are those provisioned; messages of others stay.
    """
    due = dead_letters(messages, stops, streams)
    place = F.col("offset") * 65_536 + F.col("vshard")  # source order, one place for each message
    rows = due.select("stream", "partition_key", "headers", "payload", "ts", place.alias("seq"))
    return publish(rows, streams, path, "seq", batch)


def append_records(records: DataFrame, path: str) -> DataFrame:
    """Append control records, numbered on from the log's last version in the order of their ``version``, and return them."""
    spark = records.sparkSession
    held = read(spark, path, META_LOG).agg(F.max("version").alias("last")).first()["last"]
    numbered = assign_offsets(records.select(*(F.col(c).alias(c) for c in META_LOG.names), F.lit("control").alias("log")), "version", ["log"])
    rows = numbered.withColumn("version", F.col("offset") + (0 if held is None else held + 1)).select(*META_LOG.names)
    rows.coalesce(1).write.mode("append").parquet(path)
    return read(spark, path, META_LOG).where(F.col("version") > (-1 if held is None else held))
