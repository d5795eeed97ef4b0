import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweir.functions import hashing, scalars


@pytest.mark.parametrize("key,n,shard", [("order-12345", 1024, 433), ("customer-A", 16, 9), ("hello world", 1024, 139), ("hello world", 3, 1), ("a", 2, 1)])
def test_router_vectors(key, n, shard):
    assert hashing.virtual_shard(key.encode(), n) == shard


@pytest.mark.parametrize("n", [0, -1, -(2**31)])
def test_router_needs_shards(n):
    with pytest.raises(ValueError):
        hashing.virtual_shard(b"x", n)


def test_router_unknown_algorithm():
    with pytest.raises(ValueError):
        hashing.virtual_shard(b"x", 4, "other")


@pytest.mark.parametrize("n", [1024, 3, 17])
def test_router_spreads_evenly(n):
    counts = [0] * n
    for i in range(300 * n):
        counts[hashing.virtual_shard(f"key-{i * 7919}".encode(), n)] += 1
    assert max(counts) < 300 * 1.35 and min(counts) > 300 * 0.65


def test_crc_vectors():
    assert hashing.crc32c(b"123456789") == 0xE3069283
    assert hashing.crc32c(b"") == 0


def _bitwise(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


@settings(max_examples=50)
@given(st.lists(st.binary(max_size=40), max_size=8))
def test_crc_of_many_rows(rows):
    assert hashing.crc32c_many(rows).tolist() == [_bitwise(r) for r in rows]


def test_crc_is_not_the_other_polynomial():
    assert hashing.crc32c(b"abc") != zlib.crc32(b"abc")


def test_columns(spark):
    df = spark.createDataFrame([("orders", 5, bytearray(b"order-12345"), -3), ("x", 0, None, 7)], "s string, v int, k binary, n long")
    rows = df.select(
        hashing.bootstrap_id_column(F.col("s"), F.col("v")).alias("g"), hashing.route_xxh3("k", F.lit(1024)).alias("r"), hashing.crc32c_of("k").alias("c"),
        scalars.clamp_size(F.col("n")).alias("z"), scalars.clamp_duration(F.col("n")).alias("d"), scalars.number_in_name(scalars.segment_name(F.col("v").cast("long"))).alias("p"), scalars.dead_letter_name(F.col("s")).alias("l"),
    ).collect()
    assert [r.g for r in rows] == [hashing.bootstrap_id("orders", 5), hashing.bootstrap_id("x", 0)]
    assert [r.r for r in rows] == [433, None] and [r.c for r in rows] == [hashing.crc32c(b"order-12345"), None]
    assert [(r.z, r.d, r.p) for r in rows] == [(None, 0, 5), (7, 7, 0)] and rows[0].l == "orders.__deadletter__"


def test_headers(spark):
    kind = "array<struct<key:binary,value:binary>>"
    df = spark.createDataFrame([([(bytearray(b"a"), bytearray(b"1")), (bytearray(b"a"), bytearray(b"2"))],), ([],), (None,)], f"h {kind}")
    out = df.select(scalars.header_value(F.col("h"), "a").alias("v"), F.size(scalars.default_header(F.col("h"), "a", F.encode(F.lit("x"), "UTF-8"))).alias("n")).collect()
    assert [None if r.v is None else bytes(r.v) for r in out] == [b"1", None, None] and [r.n for r in out] == [2, 1, 1]
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        df.select(scalars.header_map(F.col("h"))).collect()


def test_refusals(spark):
    df = spark.createDataFrame([(bytearray(b"k" * 65_536), []), (bytearray(b"k"), [(bytearray(b"h" * 65_536), bytearray(b""))]), (bytearray(b"k"), [])], "k binary, h array<struct<key:binary,value:binary>>")
    assert [r[0] for r in df.select(scalars.request_error(F.col("k"), F.col("h"))).collect()] == ["partition key too long", "header key too long", None]
    bad = spark.createDataFrame([("nope",)], "v string")
    with pytest.raises(Exception, match="not a valid ack mode"):
        bad.select(scalars.enum_or_raise(F.col("v"), ["Strict", "Checkpoint"], "ack mode")).collect()
    with pytest.raises(Exception, match="not a valid migration_id"):
        bad.select(scalars.guid_or_raise(F.col("v"))).collect()
    terms = spark.createDataFrame([(2, 1, 1, 9), (1, 9, 1, 9), (1, 8, 1, 9)], "a int, b int, c int, d int")
    assert [r[0] for r in terms.select(scalars.newer_or_equal(*(F.col(x) for x in "abcd"))).collect()] == [True, True, False]


def test_cutoff_never_before_year_one(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    row = spark.range(1).select(F.year(scalars.retention_cutoff(now, F.lit(2**62))).alias("y"), (scalars.retention_cutoff(now, F.lit(-5)) == now).alias("same")).first()
    assert row.y == 1 and row.same
