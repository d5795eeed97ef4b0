"""Routing, policy and access lookups against small current-state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import AUDIT_US, MAX_US, SHARD

# Current-state tables are joined without a broadcast hint: Spark broadcasts
# them itself while they are under its size threshold.


def resolve(rows: DataFrame, streams: DataFrame, assignments: DataFrame) -> DataFrame:
    """``rows(stream, vshard)`` with ``group_id``, or ``error`` where the stream or the assignment is missing."""
    found = rows.join(streams.select("stream", F.lit(True).alias("__s")), "stream", "left").join(assignments.select(*SHARD, "group_id"), SHARD, "left")
    error = F.when(F.col("__s").isNull(), "NotFound").when(F.col("group_id").isNull(), "Unavailable")
    return found.withColumn("error", error).withColumn("group_id", F.when(F.col("error").isNull(), F.col("group_id"))).drop("__s")


def redirects(groups: DataFrame, addresses: DataFrame) -> DataFrame:
    """The first member of each group, in member order, with a known address."""
    members = groups.select("group_id", F.posexplode(F.transform("members", lambda m: m["node_id"])).alias("pos", "node_id"))
    return members.join(addresses, "node_id").groupBy("group_id").agg(F.min_by(F.struct("node_id", "address"), "pos").alias("r")).select("group_id", "r.*")


def with_group_policy(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """``mode`` and ``mandatory`` of each row's group; strict and mandatory where none is set."""
    out = rows.join(policies, ["stream", "consumer_group"], "left")
    return out.withColumns({"mode": F.coalesce("mode", F.lit("Strict")), "mandatory": F.coalesce("mandatory", F.lit(True))})


def with_retention(rows: DataFrame, policies: DataFrame) -> DataFrame:
    out = rows.join(policies, "stream", "left")
    return out.withColumns({"audit_us": F.coalesce("audit_us", F.lit(AUDIT_US)), "max_us": F.coalesce("max_us", F.lit(MAX_US))})


def can_produce(requests: DataFrame, acl: DataFrame) -> DataFrame:
    """``requests(subject, stream)`` with ``allowed``; no entry denies."""
    return requests.join(acl, ["subject", "stream"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def can_consume(requests: DataFrame, acl: DataFrame) -> DataFrame:
    return requests.join(acl, ["subject", "stream", "consumer_group"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def subject(requests: DataFrame, overrides: DataFrame, default_claim: str) -> DataFrame:
    """``requests(stream, claims MAP)`` with ``subject``: the stream's claim if it names one, else the default claim."""
    out = requests.join(overrides, "stream", "left")
    return out.withColumn("subject", F.try_element_at("claims", F.coalesce("claim_type", F.lit(default_claim)))).drop("claim_type")


def needs_leader(mode: Column) -> Column:
    return mode == "Strict"


def peers(members: DataFrame, self_id: str) -> DataFrame:
    """Distinct other members."""
    return members.where(F.col("node_id") != self_id).dropDuplicates(["node_id"])
