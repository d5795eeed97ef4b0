"""The test tables seen as message logs, acks, segments and a control log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import acks, log
from ..schema import GROUP, SHARD

NOW = "2024-02-01 00:00:00"
MAX_US = 22 * 86_400_000_000  # longest retention of the bridge's stream
#: Consumer groups: each acks all offsets but those with offset % k = k - 1.
GROUPS = (("fast", 1_000_000, True), ("mid", 50, True), ("slow", 20, False))
SEGMENT_ROWS = 50


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    header = F.struct(F.encode(F.lit("props"), "UTF-8").alias("key"), F.encode(F.col("props"), "UTF-8").alias("value"))
    return e.select(
        F.lit("events").alias("stream"), F.pmod("user_id", F.lit(4)).cast("int").alias("vshard"), "ts", F.encode(F.col("user_id").cast("string"), "UTF-8").alias("partition_key"),
        F.when(F.col("props").isNotNull(), F.array(header)).otherwise(F.array().cast("array<struct<key:binary,value:binary>>")).alias("headers"),
        F.encode(F.col("event_type"), "UTF-8").alias("payload"), "event_id",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.assign_offsets(unnumbered(spark, sf_dir), "event_id")


def acked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per acked offset of each group on the events log."""
    groups = F.array(*(F.struct(F.lit(g).alias("consumer_group"), F.lit(k).alias("k"), F.lit(m).alias("mandatory")) for g, k, m in GROUPS))
    rows = messages(spark, sf_dir).select(*SHARD, "offset", F.inline(groups))
    return rows.where(F.col("offset") % F.col("k") != F.col("k") - 1).drop("k")


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applied and committed watermarks per group; all acks are committed here."""
    a = acked(spark, sf_dir)
    return acks.low_watermark(a, keys=[*GROUP, "mandatory"]).withColumn("committed_watermark", F.col("low_watermark"))


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acks.mandatory_watermark(state(spark, sf_dir), F.col("mandatory")).withColumn("safe", F.lit(0).cast("long"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events log cut every ``SEGMENT_ROWS`` offsets; written when its last message came."""
    rows = log.with_size(messages(spark, sf_dir)).withColumn("segment", F.floor(F.col("offset") / SEGMENT_ROWS))
    written = rows.groupBy(*SHARD, "segment").agg(F.max("ts").alias("written_at"))
    return log.segment_stats(rows).join(written, [*SHARD, "segment"])


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a log of one shard: the order key is the offset."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.lit("orders").alias("stream"), F.lit(0).alias("vshard"), F.col("o_orderkey").alias("offset"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").cast("string").alias("key"))


def order_acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as acks of their order by return flag, when shipped; repeats and gaps come naturally."""
    i = table(spark, sf_dir, "lineitem")
    return i.select(F.lit("orders").alias("stream"), F.lit(0).alias("vshard"), F.col("l_returnflag").alias("consumer_group"), F.col("l_orderkey").alias("offset"), F.col("l_shipdate").alias("at"))


def control_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as migration records: version by order key, 64 shards by customer, 7 migration ids, 5 groups."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    kind = F.when(key % 4 < 2, "MigrationStarted").when(key % 4 == 2, "Cutover").otherwise("MigrationAborted")
    fields = F.create_map(
        F.lit("MigrationId"), F.concat(F.lit("m"), (F.col("o_custkey") % 7).cast("string")), F.lit("StreamName"), F.lit("orders"), F.lit("VirtualShardIndex"), (F.col("o_custkey") % 64).cast("string"),
        F.lit("FromGroupId"), F.concat(F.lit("g"), (key % 5).cast("string")), F.lit("ToGroupId"), F.concat(F.lit("g"), (key % 3).cast("string")),
    )
    return o.select(key.alias("version"), kind.alias("record_type"), fields.alias("fields"), F.col("o_orderdate").alias("ts"), F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")).alias("proposed_by"))


def settings_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as policy records on streams by customer; nulls and negative values occur."""
    o = table(spark, sf_dir, "orders")
    kinds = ["SetConsumerGroupAckMode", "SetConsumerGroupMandatory", "SetStreamRetentionPolicy", "SetStreamCheckpointInterval", "SetProduceAcl", "SetConsumeAcl", "SetStreamSubjectClaimType"]
    version, part = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 7)
    q = F.floor("o_totalprice") % 50 + 1
    fields = F.create_map(
        F.lit("StreamName"), F.concat(F.lit("s"), (F.col("o_custkey") % 20).cast("string")), F.lit("ConsumerGroup"), F.concat(F.lit("c"), (part % 5).cast("string")),
        F.lit("Mode"), F.when(q % 2 == 0, "Strict").otherwise("Checkpoint"), F.lit("Mandatory"), F.when(q % 3 == 0, "false").otherwise("true"),
        F.lit("AuditRetention"), ((q - 5) * 1000).cast("string"), F.lit("MaxRetention"), (q * 2000).cast("string"), F.lit("MaxSizeBytesPerVirtualShard"), F.when(q % 4 != 0, (q - 10).cast("string")),
        F.lit("Interval"), F.when(q % 5 != 0, (q * 100).cast("string")), F.lit("OffsetCount"), F.when(q % 3 != 0, q.cast("string")),
        F.lit("Subject"), F.concat(F.lit("u"), (part % 11).cast("string")), F.lit("Allowed"), F.when(q % 2 == 0, "true").otherwise("false"), F.lit("ClaimType"), F.when(q % 2 == 0, F.concat(F.lit("claim"), (q % 3).cast("string"))),
    )
    kind = F.get(F.array(*(F.lit(k) for k in kinds)), (version % 7).cast("int"))
    return o.select(version.alias("version"), kind.alias("record_type"), fields.alias("fields"), F.col("o_orderdate").alias("ts"), F.lit(None).cast("string").alias("proposed_by"))


def nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions as groups with their nations as members, and the addresses of nations with a supplier in good standing."""
    n = table(spark, sf_dir, "nation")
    member = F.struct(F.col("n_nationkey").cast("string").alias("node_id"), F.lower("n_name").alias("address"))
    members = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", member.alias("m")))), lambda x: x["m"])
    groups = n.groupBy(F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("group_id")).agg(members.alias("members"))
    known = n.join(table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 5000), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi")
    return groups, known.select(F.col("n_nationkey").cast("string").alias("node_id"), F.lower("n_name").alias("address"))
