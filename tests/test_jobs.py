"""Writers and jobs: acks, dead letters, segments, the control log's watcher, edge rows of the log operators."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logweir.operators import compaction, control, log, metrics, retention
from logweir.schema import ACKS, META_LOG, WAL
from logweir.sources import codec, tables
from logweir.sources.segments import SegmentTable
from logweir.streaming import jobs, live

NOW = datetime(2024, 1, 31)
REQUEST = "stream string, partition_key binary, headers array<struct<key:binary,value:binary>>, payload binary, ts timestamp, seq long"


def _publish(spark, path, start, n, ts=NOW, shards=2):
    rows = spark.createDataFrame([("s", bytearray(f"k{i % 5}".encode()), [], bytearray(b"p" * 40), ts, i) for i in range(start, start + n)], REQUEST)
    return tables.publish(rows, spark.createDataFrame([("s", shards)], "stream string, vshards int"), path, batch=start)


def test_acks_are_appended_by_mode(spark, tmp_path):
    path, acks = str(tmp_path / "log"), str(tmp_path / "acks")
    _publish(spark, path, 0, 6, shards=1)
    policies = spark.createDataFrame([("s", "slow", "Checkpoint", True)], "stream string, consumer_group string, mode string, mandatory boolean")
    rows = [(0, "s", 0, "strict", [0, 99]), (1, "s", 0, "slow", [1, 99]), (2, "s", 0, "slow", [77]), (3, "s", 0, "x" * 70_000, [0])]
    asked = spark.createDataFrame(rows, "seq long, stream string, vshard int, consumer_group string, offsets array<bigint>")
    for _ in range(2):  # a repeated batch
        assert [r.error for r in tables.acknowledge(asked, policies, path, acks, batch=0).collect()] == ["consumer group name too long"]
    tables.checkpoint(spark.createDataFrame([(4, "s", 0, "slow", 5)], "seq long, stream string, vshard int, consumer_group string, watermark long"), acks, batch=1)
    got = sorted((r.seq, r.kind, r.offsets, r.watermark) for r in tables.read(spark, acks, ACKS).collect())
    assert got == [(0, "ack", [0, 99], None), (1, "local", [1], None), (4, "checkpoint", None, 5)]


def test_dead_letters_are_routed_and_numbered_again(spark, tmp_path):
    path = str(tmp_path / "log")
    _publish(spark, path, 0, 10, NOW - timedelta(hours=3))
    _publish(spark, path, 10, 4, NOW)
    gates = spark.createDataFrame([("s", v, 1, 0) for v in range(2)], "stream string, vshard int, watermark long, safe long")
    streams = spark.createDataFrame([("s", 2), ("s.__deadletter__", 3)], "stream string, vshards int")
    nowhere = {r.vshard: r.safe_to_prune for r in jobs.retention_pass(spark, path, gates, streams.limit(1), F.lit(NOW), F.lit(3_600_000_000), batch=99).collect()}
    assert nowhere == {0: 1, 1: 1}
    before = {(r.vshard, r.offset) for r in tables.read(spark, path).where("ts < timestamp'2024-01-30 23:00:00' AND offset >= 1").collect()}
    for _ in range(2):
        safe = {r.vshard: r.safe_to_prune for r in jobs.retention_pass(spark, path, gates, streams, F.lit(NOW), F.lit(3_600_000_000), batch=100).collect()}
        out = tables.read(spark, path).where("stream <> 's'").collect()
        assert len(out) == len(before) == sum(safe.values()) - 2
        for v in range(3):
            own = sorted(r.offset for r in out if r.vshard == v)
            assert own == list(range(len(own)))


def test_segments_are_compacted_and_pruned(spark, tmp_path):
    path, t = str(tmp_path / "log"), SegmentTable(spark, str(tmp_path / "segments"))
    for start in (0, 10, 20, 30):
        t.append(_publish(spark, path, start, 10), F.lit(NOW))
    want = sorted((r.vshard, r.offset) for r in tables.read(spark, path).collect())
    live_rows = lambda: sorted((r.vshard, r.offset) for r in t.rows().collect())
    assert live_rows() == want and t.catalogue().count() == 8
    assert t.compact(F.lit(NOW), None, 1) == 0  # none is old enough
    gates = spark.createDataFrame([("s", 0, 3)], "stream string, vshard int, watermark long")
    first = t.catalogue().where("vshard = 0").agg(F.min("max_offset")).first()[0]
    gates = gates.withColumn("watermark", F.lit(first + 1).cast("long"))
    assert t.compact(F.lit(NOW), None, None, lambda: t.prune(gates)) == 4  # the plan of shard 0 went stale
    assert live_rows() == [(v, o) for v, o in want if v == 1 or o > first]
    assert t.compact(F.lit(NOW), None) == 3 and t.catalogue().count() == 2
    assert t.size_prune(1, spark.createDataFrame([("s", 0)], "stream string, vshard int")) == 1
    assert {v for v, _ in live_rows()} == {0} and t.prune(gates) == 0
    seen = t._version()
    t._commit(t.catalogue(), seen)
    with pytest.raises(Exception, match="(?i)exists"):
        t._commit(t.catalogue(), seen)


def test_watched_tables_follow_the_log(spark, tmp_path):
    path, seen = str(tmp_path / "control"), []
    run = lambda: jobs.watch_tables(spark, path, lambda new, t: seen.append((new.count(), t["assignments"].count(), t["streams"].count())), str(tmp_path / "cp")).awaitTermination()
    made = tables.append_records(control.records(spark, control.create_stream("s", 2, {0: "a", 1: "b"}), 0, "2024-01-01"), path)
    assert sorted(r.version for r in made.collect()) == list(range(5))
    run()
    more = tables.append_records(control.records(spark, [control.reshard_commands("start", "m", "s", 0, "a", "b")], 0, "2024-01-01"), path)
    assert [r.version for r in more.collect()] == [5]
    run()
    assert seen == [(5, 2, 1), (1, 2, 1)]
    assert jobs.watch_stream(spark, path, 3).isStreaming and tables.read(spark, path, META_LOG).count() == 6


def test_applied_records_and_timings(spark, tmp_path):
    path, out, timings = str(tmp_path / "wal"), [], jobs.Timings()
    spark.createDataFrame([("Append", 1, i, i, NOW, None, None, None) for i in range(6)], WAL).coalesce(1).write.parquet(path)
    spark.streams.addListener(timings)
    q = jobs.applied_stream(spark, path, 2).writeStream.queryName("applied").foreachBatch(lambda d, n: out.extend(d.collect())).option("checkpointLocation", str(tmp_path / "cp"))
    q.trigger(availableNow=True).start().awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(timings)
    assert sorted(r.raft_index for r in out) == [2, 3, 4, 5]
    assert timings.batches.get("applied", 0) >= 1 and timings.rows["applied"] == 6 and timings.millis["applied", "triggerExecution"] > 0


def test_tail_goes_on_where_it_was(spark, tmp_path):
    path, more = str(tmp_path / "log"), [True]
    _publish(spark, path, 0, 6, shards=1)
    state = spark.createDataFrame([("s", 0, "g", 2)], "stream string, vshard int, consumer_group string, low_watermark long")

    def again():
        if more.pop() if more else False:
            _publish(spark, path, 6, 3, shards=1)
            return True
        return False

    assert [r.offset for r in jobs.tail(spark, path, state, "g", again)] == list(range(2, 9))


class _Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class _Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, name, schema):
        return _Value()

    def registerTimer(self, ms):
        self.timers.append(ms)


class _At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentProcessingTimeInMs


def test_a_silent_group_reaches_its_interval():
    import pandas as pd

    p, h = live.CheckpointProcessor(10_000_000, None, ticking=True), _Handle()
    p.init(h)
    rows = lambda *r: iter([pd.DataFrame(r, columns=["low_watermark", "at_us"])])
    key = ("s", 0, "g")
    first = pd.concat(p.handleInputRows(key, rows((2, 1_000_000), (4, 2_000_000)), _At(2000)))
    assert first.watermark.tolist() == [2] and h.timers == [12_000]
    assert pd.concat(p.handleExpiredTimer(key, _At(12_000), _At(12_000))).watermark.tolist() == [4]
    assert pd.concat(p.handleExpiredTimer(key, _At(30_000), _At(30_000))).empty


def test_ticking_checkpoints_run(spark, tmp_path):
    source, out = str(tmp_path / "p"), []
    kind = "stream string, vshard int, consumer_group string, low_watermark long, at_us long"
    spark.createDataFrame([("s", 0, "g", 2, 0), ("s", 0, "g", 4, 5_000_000)], kind).coalesce(1).write.parquet(source)
    q = live.checkpoint_stream(spark.readStream.schema(kind).parquet(source), 1_000_000, ticking=True).writeStream.outputMode("append").foreachBatch(lambda d, n: out.extend(d.collect()))
    spark.createDataFrame([("s", 0, "g", 2, 0), ("s", 0, "g", 4, 500_000)], kind).coalesce(1).write.mode("overwrite").parquet(source)
    q = q.option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    until = time.time() + 60
    while time.time() < until and len(out) < 2 and q.isActive:
        time.sleep(0.5)
    q.stop()
    assert [r.watermark for r in out] == [2, 4]


def test_rows_without_arrival_or_key_are_numbered(spark):
    df = spark.createDataFrame([("s", 0, 5, "a"), ("s", 0, None, "b"), (None, 0, 1, "c"), (None, 0, 0, "d"), ("s", None, 3, "e")], "stream string, vshard int, a long, n string")
    got = {r.n: r.offset for r in log.assign_offsets(df, "a").collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 0}
    base = spark.createDataFrame([(None, 0, 7)], "stream string, vshard int, next_offset long")
    assert {r.n: r.offset for r in log.assign_offsets(df, "a", base=base).collect()}["c"] == 8


def test_finished_and_empty_shards_stay(spark):
    m = spark.createDataFrame([("s", 0, 0, NOW)], "stream string, vshard int, offset long, ts timestamp")
    g = spark.createDataFrame([("s", 0, 1, 1), ("s", 1, 4, 4)], "stream string, vshard int, watermark long, safe long")
    stops = retention.retention_stops(m, g, F.lit(NOW), F.lit(1))
    assert sorted((r.vshard, r.safe_to_prune) for r in retention.safe_to_prune(stops).collect()) == [(0, 1), (1, 4)]
    state = spark.createDataFrame([("s", 0, "g", 1), ("s", 1, "g", 0)], "stream string, vshard int, consumer_group string, committed_watermark long")
    assert sorted((r.vshard, r.depth) for r in metrics.queue_depth(state, log.next_offset(m)).collect()) == [(0, 0), (1, 0)]


def test_nulls_of_the_codec(spark):
    kind = "t string, a long, b long, c long, d long, k binary, h array<struct<key:binary,value:binary>>, p binary"
    df = spark.createDataFrame([("Append", 1, 2, 3, 4, bytearray(b"k"), [], bytearray(b"p")), ("NoOp", 1, 2, None, 4, None, None, None), (None, 1, 2, 3, 4, None, None, None), ("Append", None, 2, 3, 4, None, None, None)], kind)
    raw = df.select("t", "a", codec.wal_bytes("t", "a", "b", "c", "d", "k", "h", "p").alias("raw"))
    rows = raw.select("t", "a", codec.wal_record("raw").alias("r")).collect()
    assert [(r.r.status, r.r.offset) for r in rows] == [("ok", 3), ("ok", 0), (None, None), (None, None)]


def test_first_of_repeated_rows_and_long_folds(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 2, "a"), (1, None, "c"), (2, None, "d")], "offset long, at long, x string")
    assert sorted(r.x for r in log.replay_dedup(df, ["offset"], "at").collect()) == ["a", "d"]
    n = 1500  # several blocks
    s = spark.createDataFrame([("s", 0, i, i, 3) for i in range(n)], "stream string, vshard int, min_offset long, max_offset long, bytes long")
    assert [r.merge_group for r in compaction.merge_groups(s, 7).orderBy("min_offset").collect()] == [i // 2 for i in range(n)]
