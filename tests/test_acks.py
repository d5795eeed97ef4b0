import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweir.operators import acks
from logweir.operators.acks import AckState

GOLDEN = [
    ([], 0, 0), ("A0 A1 A2", 3, 3), ("A0,1,2", 3, 3), ("A5", 0, 0), ("A0 A2 A1", 3, 3), ("A0 A1 A0", 2, 2), ("L0,1,2", 3, 0), ("L0,1,2 A2", 3, 0),
    ("C10", 10, 10), ("C10 C10 C5", 10, 10), ("A20 C21", 21, 21), ("C500", 500, 500), ("A5 C5", 5, 5), ("A5 C5 A5", 6, 6),
]


def _events(script):
    for e in (script.split() if script else []):
        numbers = [int(x) for x in e[1:].split(",")]
        yield {"A": "ack", "L": "local", "C": "checkpoint"}[e[0]], None if e[0] == "C" else numbers, numbers[0] if e[0] == "C" else None


@pytest.mark.parametrize("script,low,committed", GOLDEN)
def test_golden_state(script, low, committed):
    s = AckState()
    for e in _events(script):
        s.apply(*e)
    assert (s.low, s.committed) == (low, committed)


def test_fold_matches_state_machine(spark):
    rows, want = [], {}
    for i, (script, low, committed) in enumerate(GOLDEN[1:]):
        rows += [(n, "s", 0, f"g{i}", k, o, w) for n, (k, o, w) in enumerate(_events(script))]
        want[f"g{i}"] = (low, committed)
    df = spark.createDataFrame(rows, "seq long, stream string, vshard int, consumer_group string, kind string, offsets array<long>, watermark long")
    got = {r.consumer_group: (r.low_watermark, r.committed_watermark) for r in acks.fold_acks(df.orderBy(F.rand(1))).collect()}
    assert got == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 12)), max_size=30))
def test_watermark_equals_fold(spark, rows):
    want = {g: AckState() for g in "ab"}
    for g, o in rows:
        want[g].ack([o])
    df = spark.createDataFrame([("s", 0, g, o) for g, o in rows], "stream string, vshard int, consumer_group string, offset long")
    groups = spark.createDataFrame([("s", 0, "a"), ("s", 0, "b")], "stream string, vshard int, consumer_group string")
    got = acks.low_watermark(df, groups)
    assert {r.consumer_group: r.low_watermark for r in got.collect()} == {g: s.low for g, s in want.items()}
    held = {(r.consumer_group, r.offset) for r in acks.selective(df, got).collect()}
    assert held == {(g, o) for g, s in want.items() for o in s.selective}


def test_gates(spark):
    state = spark.createDataFrame([("s", 0, "a", 5, 3, True), ("s", 0, "b", 1, 1, False), ("s", 1, "c", 9, 9, False)], "stream string, vshard int, consumer_group string, low_watermark long, committed_watermark long, mandatory boolean")
    shards = spark.createDataFrame([("s", i) for i in range(3)], "stream string, vshard int")
    by = lambda df: {r.vshard: r.watermark for r in df.collect()}
    assert by(acks.all_groups_watermark(state, shards)) == {0: 1, 1: 9, 2: 0}
    assert by(acks.mandatory_watermark(state, F.col("mandatory"), shards)) == {0: 3, 1: 0, 2: 0}
    assert {r.vshard: r.slowest for r in acks.slowest_mandatory(state, F.col("mandatory")).collect()} == {0: "a", 1: None}
