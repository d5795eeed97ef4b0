"""The ordered control log: its folds to current state, its description and its commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import bootstrap_id
from ..functions.scalars import clamp_duration, clamp_size, header_value, is_dead_letter
from ..schema import AUDIT_US, MAX_US, META_LOG, SHARD

RECORD_TYPES = (
    "CreateStream", "RegisterGroup", "MigrationStarted", "MigrationAborted", "Cutover", "MigrationCompleted", "SetConsumerGroupAckMode",
    "SetConsumerGroupMandatory", "SetStreamRetentionPolicy", "SetStreamCheckpointInterval", "SetProduceAcl", "SetConsumeAcl", "SetStreamSubjectClaimType",
)


def newer(meta_log: DataFrame, last: int | None) -> DataFrame:
    """Records beyond the last applied version, each version once; versions start at 0, so None means none yet."""
    rows = meta_log if last is None else meta_log.where(F.col("version") > last)
    return rows.dropDuplicates(["version"])


def watch(meta_log: DataFrame, start: int) -> DataFrame:
    return meta_log.where(F.col("version") >= start).orderBy("version")


def last_version(meta_log: DataFrame) -> DataFrame:
    return meta_log.agg(F.coalesce(F.max("version"), F.lit(0).cast("long")).alias("last_version"))


def _field(name: str) -> Column:
    return F.col("fields")[name]


def _latest(meta_log: DataFrame, kind: str, keys: dict[str, str], values: dict[str, Column]) -> DataFrame:
    """Last write of ``kind`` per key, nulls included."""
    rows = meta_log.where(F.col("record_type") == kind)
    last = F.max_by(F.struct(*(v.alias(n) for n, v in values.items())), "version").alias("__v")
    return rows.groupBy(*(_field(f).alias(k) for k, f in keys.items())).agg(last).select(*keys, "__v.*")


def streams(meta_log: DataFrame) -> DataFrame:
    return _latest(meta_log, "CreateStream", {"stream": "StreamName"}, {"vshards": _field("VirtualShardCount").cast("int"), "algorithm": _field("RoutingAlgorithm")})


def groups(meta_log: DataFrame) -> DataFrame:
    """Members are listed as ``node@address`` joined by a comma and a space."""
    pairs = F.transform(F.split(_field("Members"), ", "), lambda m: F.struct(F.substring_index(m, "@", 1).alias("node_id"), F.regexp_extract(m, "^[^@]*@(.*)$", 1).alias("address")))
    return _latest(meta_log, "RegisterGroup", {"group_id": "GroupId"}, {"members": F.when(_field("Members") == "", F.array().cast("array<struct<node_id:string,address:string>>")).otherwise(pairs)})


def assignments(meta_log: DataFrame) -> DataFrame:
    """Current group of each virtual shard, its migration target and migration id, folded in version order.

    A start is ignored while another migration runs and when it repeats the
    recorded one; an abort or cutover counts only for the recorded migration; a
    cutover keeps the id, so that its start cannot be replayed.
    """
    kinds = ("MigrationStarted", "MigrationAborted", "Cutover")
    rows = meta_log.where(F.col("record_type").isin(*kinds))
    event = F.struct("version", "record_type", _field("MigrationId").alias("id"), _field("FromGroupId").alias("source"), _field("ToGroupId").alias("target"))

    def step(s: Column, e: Column) -> Column:
        kind, same = e["record_type"], F.coalesce(s["id"] == e["id"], F.lit(False))
        start = (kind == "MigrationStarted") & ~same & s["to"].isNull()
        abort, cut = (kind == "MigrationAborted") & same, (kind == "Cutover") & same
        return F.struct(
            F.when(start, e["source"]).when(cut, e["target"]).otherwise(s["group"]).alias("group"),
            F.when(start, e["target"]).when(abort | cut, F.lit(None)).otherwise(s["to"]).alias("to"),
            F.when(start, e["id"]).when(abort, F.lit(None)).otherwise(s["id"]).alias("id"),
        )

    none = F.lit(None).cast("string")
    init = F.struct(none.alias("group"), none.alias("to"), none.alias("id"))
    folded = rows.groupBy(_field("StreamName").alias("stream"), _field("VirtualShardIndex").cast("int").alias("vshard")).agg(F.array_sort(F.collect_list(event)).alias("e"))
    out = folded.select("stream", "vshard", F.aggregate("e", init, step).alias("s"))
    return out.where(F.col("s.group").isNotNull()).select(*SHARD, F.col("s.group").alias("group_id"), F.col("s.to").alias("migrating_to"), F.col("s.id").alias("migration_id"))


def group_policies(meta_log: DataFrame) -> DataFrame:
    """Mode and mandatory flag per consumer group, each by its own last write; strict and mandatory by default."""
    kinds = ("SetConsumerGroupAckMode", "SetConsumerGroupMandatory")
    rows = meta_log.where(F.col("record_type").isin(*kinds)).groupBy(_field("StreamName").alias("stream"), _field("ConsumerGroup").alias("consumer_group"))
    last = lambda kind, name: F.max_by(_field(name), F.when(F.col("record_type") == kind, F.col("version")))
    return rows.agg(F.coalesce(last(kinds[0], "Mode"), F.lit("Strict")).alias("mode"), F.coalesce(last(kinds[1], "Mandatory").cast("boolean"), F.lit(True)).alias("mandatory"))


def retention_policies(meta_log: DataFrame) -> DataFrame:
    """Retention and checkpoint settings per stream; negative durations are 0, a negative size is no limit."""
    kinds = ("SetStreamRetentionPolicy", "SetStreamCheckpointInterval")
    rows = meta_log.where(F.col("record_type").isin(*kinds)).groupBy(_field("StreamName").alias("stream"))
    at = lambda kind: F.when(F.col("record_type") == kind, F.col("version"))
    num = lambda name, kind, to="long": F.max_by(F.nullif(_field(name), F.lit("")).cast(to), at(kind))
    return rows.agg(
        F.coalesce(clamp_duration(num("AuditRetention", kinds[0])), F.lit(AUDIT_US)).alias("audit_us"),
        F.coalesce(clamp_duration(num("MaxRetention", kinds[0])), F.lit(MAX_US)).alias("max_us"),
        clamp_size(num("MaxSizeBytesPerVirtualShard", kinds[0])).alias("max_bytes"),
        num("Interval", kinds[1]).alias("checkpoint_us"),
        num("OffsetCount", kinds[1], "int").alias("checkpoint_count"),
    )


def produce_acl(meta_log: DataFrame) -> DataFrame:
    return _latest(meta_log, "SetProduceAcl", {"subject": "Subject", "stream": "StreamName"}, {"allowed": _field("Allowed").cast("boolean")})


def consume_acl(meta_log: DataFrame) -> DataFrame:
    return _latest(meta_log, "SetConsumeAcl", {"subject": "Subject", "stream": "StreamName", "consumer_group": "ConsumerGroup"}, {"allowed": _field("Allowed").cast("boolean")})


def claim_overrides(meta_log: DataFrame) -> DataFrame:
    """Claim type per stream; an empty or null one clears the override."""
    return _latest(meta_log, "SetStreamSubjectClaimType", {"stream": "StreamName"}, {"claim_type": F.nullif(_field("ClaimType"), F.lit(""))})


def describe(meta_log: DataFrame) -> DataFrame:
    """The audit view: version, type, fields with nulls as empty strings, time and proposer."""
    fields = F.transform_values("fields", lambda _, v: F.coalesce(v, F.lit("")))
    return meta_log.select("version", "record_type", fields.alias("fields"), F.unix_micros("ts").alias("timestamp_micros"), F.coalesce("proposed_by", F.lit("")).alias("proposed_by"))


def proposed_by(headers: Column) -> Column:
    return F.decode(header_value(headers, "proposed-by"), "UTF-8")


def primary_stream(assigned: DataFrame) -> DataFrame:
    """A group's stream that is not a dead-letter stream, else its dead-letter stream: the first by name."""
    plain = F.min(F.when(~is_dead_letter(F.col("stream")), F.col("stream")))
    return assigned.groupBy("group_id").agg(F.coalesce(plain, F.min("stream")).alias("stream"))


def covers_every_index(assigned: DataFrame, streams_: DataFrame) -> DataFrame:
    """Whether a stream's shard numbers are exactly 0 to n - 1; repeats are tolerated."""
    seen = assigned.groupBy("stream").agg(F.count_distinct("vshard").alias("n"), F.min("vshard").alias("lo"), F.max("vshard").alias("hi"))
    ok = (F.col("n") == F.col("vshards")) & (F.col("lo") == 0) & (F.col("hi") == F.col("vshards") - 1)
    return streams_.join(seen, "stream", "left").select("stream", F.coalesce(ok, F.col("vshards") == 0).alias("covered"))


def records(spark: SparkSession, commands: list[tuple[str, dict[str, str | None]]], start: int, ts: str, by: str | None = None) -> DataFrame:
    """Control-log rows for ``commands`` from version ``start`` on; append them to the log's table."""
    rows = [(start + i, kind, {k: v for k, v in fields.items()}, ts, by) for i, (kind, fields) in enumerate(commands)]
    out = spark.createDataFrame(rows, "version long, record_type string, fields map<string,string>, ts string, proposed_by string")
    return out.withColumn("ts", F.col("ts").cast("timestamp")).select(*META_LOG.names)


def create_stream(stream: str, vshards: int, placement: dict[int, str], algorithm: str = "XxHash3V1") -> list[tuple[str, dict[str, str | None]]]:
    """Commands that create a stream: its config, then start and cutover of each shard's first assignment.

    ``placement`` must name a group for every shard from 0 to ``vshards - 1``.
    """
    if vshards <= 0 or set(placement) != set(range(vshards)):
        raise ValueError("assignments must cover every virtual shard exactly once")
    out: list[tuple[str, dict[str, str | None]]] = [("CreateStream", {"StreamName": stream, "VirtualShardCount": str(vshards), "RoutingAlgorithm": algorithm})]
    for shard, group in sorted(placement.items()):
        base = {"MigrationId": bootstrap_id(stream, shard), "StreamName": stream, "VirtualShardIndex": str(shard)}
        out += [("MigrationStarted", base | {"FromGroupId": group, "ToGroupId": group}), ("Cutover", base | {"ToGroupId": group})]
    return out


def reshard_commands(step: str, migration: str, stream: str, vshard: int, source: str | None = None, target: str | None = None) -> tuple[str, dict[str, str | None]]:
    """The record of one reshard step: start, cutover, complete or abort."""
    base: dict[str, str | None] = {"MigrationId": migration, "StreamName": stream, "VirtualShardIndex": str(vshard)}
    kinds = {"start": ("MigrationStarted", {"FromGroupId": source, "ToGroupId": target}), "cutover": ("Cutover", {"ToGroupId": target}), "complete": ("MigrationCompleted", {}), "abort": ("MigrationAborted", {})}
    kind, more = kinds[step]
    return kind, base | more


Command = tuple[str, dict[str, str | None]]


def _need(**names: str | None) -> None:
    for what, value in names.items():
        if not value:
            raise ValueError(f"{what} is required")


def set_group_flag(stream: str, group: str, mode: str | None = None, mandatory: bool | None = None) -> list[Command]:
    """One record for each flag given."""
    _need(stream=stream, group=group)
    if mode not in (None, "Strict", "Checkpoint"):
        raise ValueError(f"'{mode}' is not a valid ack mode")
    base: dict[str, str | None] = {"StreamName": stream, "ConsumerGroup": group}
    out: list[Command] = [] if mode is None else [("SetConsumerGroupAckMode", base | {"Mode": mode})]
    return out if mandatory is None else [*out, ("SetConsumerGroupMandatory", base | {"Mandatory": str(mandatory).lower()})]


def set_stream_policy(stream: str, retention_us: tuple[int, int] | None = None, max_bytes: int | None = None, checkpoint: tuple[int | None, int | None] | None = None) -> list[Command]:
    """Retention ``(audit, max)`` with its size limit, and checkpoint ``(interval, offsets)``, whichever is given."""
    _need(stream=stream)
    text = lambda v: None if v is None else str(v)
    out: list[Command] = []
    if retention_us is not None:
        out.append(("SetStreamRetentionPolicy", {"StreamName": stream, "AuditRetention": str(retention_us[0]), "MaxRetention": str(retention_us[1]), "MaxSizeBytesPerVirtualShard": text(max_bytes)}))
    if checkpoint is not None:
        out.append(("SetStreamCheckpointInterval", {"StreamName": stream, "Interval": text(checkpoint[0]), "OffsetCount": text(checkpoint[1])}))
    return out


def manage_acl(subject: str, stream: str, allowed: bool, group: str | None = None) -> Command:
    """A consume entry with a group, a produce entry without."""
    _need(subject=subject, stream=stream)
    base: dict[str, str | None] = {"Subject": subject, "StreamName": stream, "Allowed": str(allowed).lower()}
    return ("SetProduceAcl", base) if group is None else ("SetConsumeAcl", base | {"ConsumerGroup": group})


def register_group(group: str, members: dict[str, str]) -> Command:
    _need(group=group)
    return "RegisterGroup", {"GroupId": group, "Members": ", ".join(f"{n}@{a}" for n, a in members.items())}


def set_claim_type(stream: str, claim: str | None) -> Command:
    _need(stream=stream)
    return "SetStreamSubjectClaimType", {"StreamName": stream, "ClaimType": claim}
