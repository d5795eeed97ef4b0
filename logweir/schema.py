"""Canonical schemas, defaults and names of a sharded message log."""

from __future__ import annotations

from pyspark.sql import types as T

HEADERS = T.ArrayType(T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())]))

MESSAGES = T.StructType([
    T.StructField("stream", T.StringType()), T.StructField("vshard", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("partition_key", T.BinaryType()), T.StructField("headers", HEADERS), T.StructField("payload", T.BinaryType()),
])
WAL = T.StructType([
    T.StructField("record_type", T.StringType()), T.StructField("raft_term", T.LongType()), T.StructField("raft_index", T.LongType()), T.StructField("offset", T.LongType()),
    T.StructField("ts", T.TimestampType()), T.StructField("partition_key", T.BinaryType()), T.StructField("headers", HEADERS), T.StructField("payload", T.BinaryType()),
])
ACKS = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("stream", T.StringType()), T.StructField("vshard", T.IntegerType()), T.StructField("consumer_group", T.StringType()),
    T.StructField("kind", T.StringType()), T.StructField("offsets", T.ArrayType(T.LongType())), T.StructField("watermark", T.LongType()),
])
ACK_STATE = T.StructType([
    T.StructField("stream", T.StringType()), T.StructField("vshard", T.IntegerType()), T.StructField("consumer_group", T.StringType()), T.StructField("low_watermark", T.LongType()),
    T.StructField("committed_watermark", T.LongType()), T.StructField("selective", T.ArrayType(T.LongType())), T.StructField("committed_selective", T.ArrayType(T.LongType())),
])
META_LOG = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("record_type", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("ts", T.TimestampType()), T.StructField("proposed_by", T.StringType()),
])

SHARD = ["stream", "vshard"]
GROUP = [*SHARD, "consumer_group"]

DEAD_LETTER_SUFFIX = ".__deadletter__"
#: Bytes a buffered message takes besides its key, headers and payload; flush and rotation size; records to an index entry.
MESSAGE_OVERHEAD, FLUSH_BYTES, INDEX_EVERY = 48, 64 << 20, 128
#: Longest partition key, header key and group name in bytes; most headers.
MOST_U16 = 65_535
DAY_US = 86_400_000_000
#: Policies where none is set: audit 7 days, at most 30 days, no size limit; strict and mandatory groups.
AUDIT_US, MAX_US = 7 * DAY_US, 30 * DAY_US
CHECKPOINT_INTERVAL_US = 30_000_000
