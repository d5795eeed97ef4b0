from datetime import datetime

from pyspark.sql import functions as F

from logweir.operators import acks
from logweir.schema import ACKS
from logweir.sources import tables
from logweir.streaming import live

T0 = datetime(2024, 1, 1, 0, 0, 0, 123456)
REQUEST = "stream string, partition_key binary, headers array<struct<key:binary,value:binary>>, payload binary, ts timestamp, seq long"


def _requests(spark, start, n):
    return spark.createDataFrame([("orders", bytearray(f"k{i % 7}".encode()), [], bytearray(b"p"), T0, i) for i in range(start, start + n)], REQUEST)


def _streams(spark):
    return spark.createDataFrame([("orders", 3)], "stream string, vshards int")


def test_publish_continues_offsets(spark, tmp_path):
    path = str(tmp_path / "log")
    assert tables.read(spark, path).count() == 0
    tables.publish(_requests(spark, 0, 20), _streams(spark), path, batch=0)
    tables.publish(_requests(spark, 20, 10), _streams(spark), path, batch=1)
    tables.publish(_requests(spark, 20, 10), _streams(spark), path, batch=1)  # a repeated batch
    rows = tables.read(spark, path).collect()
    assert len(rows) == 30 and all(r.ts.microsecond == 123000 for r in rows)
    for v in range(3):
        own = sorted(r.offset for r in rows if r.vshard == v)
        assert own == list(range(len(own)))
    assert all(bytes(r.headers[0]["key"]) == b"correlation-id" for r in rows)


def test_published_stream_can_be_tailed(spark, tmp_path):
    path, seen = str(tmp_path / "log"), []
    source = str(tmp_path / "in")
    _requests(spark, 0, 12).write.parquet(source)
    stream = spark.readStream.schema(REQUEST).parquet(source)
    live.publish_stream(stream, _streams(spark), path, str(tmp_path / "cp")).awaitTermination()
    _requests(spark, 12, 5).write.mode("append").parquet(source)
    live.publish_stream(stream, _streams(spark), path, str(tmp_path / "cp")).awaitTermination()
    assert tables.read(spark, path).count() == 17
    state = spark.createDataFrame([("orders", v, "g", 1) for v in range(3)], "stream string, vshard int, consumer_group string, low_watermark long")
    live.consume_stream(spark, path, lambda: state, "g", lambda b, n: seen.extend(b.collect()), str(tmp_path / "cp2")).awaitTermination()
    assert seen and min(r.offset for r in seen) == 1


def _acks(spark, rows):
    return spark.createDataFrame([(s, "orders", 0, g, k, o, w) for s, g, k, o, w in rows], ACKS)


def test_ack_stream_survives_a_restart(spark, tmp_path):
    source, out = str(tmp_path / "acks"), []
    rows = [(0, "a", "ack", [0, 1], None), (1, "a", "ack", [3], None), (2, "b", "local", [0], None), (3, "b", "checkpoint", None, 5), (4, "a", "ack", [2], None), (5, "b", "ack", [5], None)]

    def run():
        q = live.ack_state_stream(live.ack_stream(spark, source)).writeStream.outputMode("update").foreachBatch(lambda d, n: out.extend(d.collect()))
        q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    _acks(spark, rows[:3]).coalesce(1).write.parquet(source)
    run()
    assert {r.consumer_group: r.low_watermark for r in out} == {"a": 2, "b": 1}
    _acks(spark, rows[3:] + rows[:1]).coalesce(1).write.mode("append").parquet(source)  # one event comes again
    run()
    last = {r.consumer_group: (r.low_watermark, r.committed_watermark) for r in out}
    want = {r.consumer_group: (r.low_watermark, r.committed_watermark) for r in acks.fold_acks(_acks(spark, rows)).collect()}
    assert last == want == {"a": (4, 4), "b": (6, 6)}


def test_checkpoint_stream(spark, tmp_path):
    source = str(tmp_path / "p")
    kind = "stream string, vshard int, consumer_group string, low_watermark long, at_us long"
    spark.createDataFrame([("s", 0, "g", 2, 0), ("s", 0, "g", 4, 5_000_000), ("s", 0, "g", 5, 12_000_000), ("s", 0, "g", 6, 40_000_000)], kind).coalesce(1).write.parquet(source)
    out = []
    q = live.checkpoint_stream(spark.readStream.schema(kind).parquet(source)).writeStream.outputMode("append").foreachBatch(lambda d, n: out.extend(d.collect()))
    q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.watermark, r.at_us) for r in out) == [(2, 0), (6, 40_000_000)]


def test_unacked_rows_come_again(spark):
    m = spark.createDataFrame([("s", 0, i) for i in range(5)], "stream string, vshard int, offset long")
    state = spark.createDataFrame([("s", 0, "g", 2, [3])], "stream string, vshard int, consumer_group string, low_watermark long, selective array<long>")
    at = lambda **k: sorted(r.offset for r in live.consume(m, state, "g", **k).collect())
    assert at() == [2, 3, 4] and at(skip_selective=True) == [2, 4]
    assert live.consume(m, state, "other").where(F.col("offset") == 0).count() == 1


def test_reshard_rounds_and_snapshots(spark, tmp_path):
    path, target, other = (str(tmp_path / x) for x in ("a", "b", "c"))
    tables.publish(_requests(spark, 0, 20), _streams(spark), path)
    source = lambda: tables.read(spark, path).where("vshard = 1")
    n = source().count()
    at = tables.copy_until_caught_up(source, target, "copy", 0, F.lit(T0))
    assert at == n and sorted(r.offset for r in tables.read(spark, target).collect()) == list(range(n))
    tables.publish(_requests(spark, 20, 20), _streams(spark), path)
    more = source().count()
    assert tables.copy_until_caught_up(source, target, "copy", 0, F.lit(T0), at) == more
    assert sorted(r.offset for r in tables.read(spark, target).collect()) == list(range(more))
    assert tables.snapshot_files(tables.read(spark, path), 10)
    assert tables.install_snapshot(tables.read(spark, path), other).count() == 40
