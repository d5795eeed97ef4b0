from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweir.operators import compaction, log, metrics, retention

NOW = datetime(2024, 1, 31)
HOUR = 3_600_000_000
MSG = "stream string, vshard int, offset long, ts timestamp"
SEG = "stream string, vshard int, min_offset long, max_offset long, bytes long"


def _walk(rows, gate, safe, cutoff, can_forward=True):
    """The retention pass as a plain loop."""
    sent = []
    for o, ts in rows:
        if o < safe:
            continue
        if o < gate:
            safe = o + 1
            continue
        if ts > cutoff or not can_forward:
            break
        sent.append(o)
        safe = o + 1
    return safe, sent


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("ages,gate,safe", [([2], 0, 0), ([2], 1, 0), ([0], 0, 0), ([5, 4, 0, 3], 0, 0), ([5, 4, 3], 1, 1), ([1], 0, 0), ([3, 3, 3], 0, 2)])
def test_retention_walk(spark, ages, gate, safe, forward):
    rows = [(i, NOW - timedelta(hours=a)) for i, a in enumerate(ages)]
    m = spark.createDataFrame([("s", 0, *r) for r in rows], MSG)
    g = spark.createDataFrame([("s", 0, gate, safe)], "stream string, vshard int, watermark long, safe long")
    stops = retention.retention_stops(m, g, F.lit(NOW), F.lit(HOUR), None if forward else F.lit(False))
    want_safe, want_sent = _walk(rows, gate, safe, NOW - timedelta(hours=1), forward)
    assert retention.safe_to_prune(stops).first().safe_to_prune == want_safe
    out = retention.dead_letters(m, stops)
    assert sorted(r.offset for r in out.collect()) == want_sent
    assert {r.stream for r in out.collect()} <= {"s.__deadletter__"}
    nowhere = spark.createDataFrame([("s",)], "stream string")
    assert retention.dead_letters(m, stops, nowhere).count() == 0


def _segments(spark, sizes):
    return spark.createDataFrame([("s", 0, 5 * i, 5 * i + 4, b) for i, b in enumerate(sizes)], SEG)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=12), st.one_of(st.none(), st.integers(1, 120)))
def test_greedy_packing(spark, sizes, most):
    want, group, held, n = [], 0, 0, 0
    for b in sizes:
        if n and most is not None and held + b > most:
            group, held, n = group + 1, 0, 0
        held, n = held + b, n + 1
        want.append(group)
    got = compaction.merge_groups(_segments(spark, sizes), most).orderBy("min_offset").collect()
    assert [r.merge_group for r in got] == want


def test_plan_replaces_its_sources(spark):
    s = _segments(spark, [90, 30, 40, 80, 5])
    plan = compaction.first_plan(compaction.merge_groups(s, 100))
    assert sorted(r.min_offset for r in plan.collect()) == [5, 10]
    merged = compaction.merged_segments(plan).drop("merge_group")
    out = compaction.replace_in(s, plan, merged).collect()
    assert [(r.min_offset, r.max_offset, r.bytes) for r in out] == [(0, 4, 90), (5, 14, 70), (15, 19, 80), (20, 24, 5)]
    assert compaction.stale_plans(plan, s).count() == 0
    assert compaction.stale_plans(plan, s.where("min_offset <> 5")).count() == 1


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.booleans()), min_size=1, max_size=10), st.integers(0, 200))
def test_size_floor(spark, rows, most):
    total, want = sum(b for b, _ in rows), []
    for i, (b, readable) in enumerate(rows):
        if total <= most:
            break
        if readable:
            want.append(5 * i)
            total -= b
    s = _segments(spark, [b for b, _ in rows])
    ok = F.col("min_offset").isin([5 * i for i, (_, r) in enumerate(rows) if r])
    got = retention.size_floor_prune(s, most, ok)
    assert sorted(r.min_offset for r in got.collect()) == want
    assert sum(r.messages for r in metrics.forced_prune_total(got).collect()) == 5 * len(want)
    assert retention.size_floor_prune(s, None).count() == 0


def test_prune_keeps_straddlers(spark):
    g = spark.createDataFrame([("s", 0, 9)], "stream string, vshard int, watermark long")
    assert [r.min_offset for r in retention.prunable_segments(_segments(spark, [1, 1, 1]), g).collect()] == [0]


def test_audit_is_only_enforced_on_demand(spark):
    s = spark.createDataFrame([("s", 0, 0, 4, 1, NOW - timedelta(hours=1))], SEG + ", written_at timestamp")
    assert retention.audit_kept(s, F.lit(NOW), F.lit(2 * HOUR)).count() == 1
    assert retention.audit_kept(s, F.lit(NOW), F.lit(2 * HOUR), enforce_audit=True).count() == 0


@pytest.mark.parametrize("interval,count,want", [(None, None, [True, False, False, True]), (None, 3, [False, True, False, False]), (10_000_000, 3, [True, False, True, True])])
def test_checkpoint_due(spark, interval, count, want):
    t = datetime(2024, 1, 1)
    rows = [(0, t, 2), (1, t + timedelta(seconds=5), 4), (2, t + timedelta(seconds=12), 5), (3, t + timedelta(seconds=40), 6)]
    p = spark.createDataFrame([("s", 0, "g", *r) for r in rows], "stream string, vshard int, consumer_group string, seq long, at timestamp, low_watermark long")
    if count == 3 and interval is None:
        want = [False, True, False, False]
    got = compaction.checkpoint_due(p, interval, count).orderBy("seq").collect()
    assert [r.due for r in got] == want


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 10_000)), min_size=1, max_size=40, unique_by=lambda x: x[1]), st.integers(1, 9))
def test_offsets_are_gapless(spark, rows, buckets):
    df = spark.createDataFrame([("s", v, a) for v, a in rows], "stream string, vshard int, a long")
    base = spark.createDataFrame([("s", 1, 100)], "stream string, vshard int, next_offset long")
    got = log.assign_offsets(df, "a", base=base, buckets=buckets).collect()
    for v in range(3):
        own = sorted((r.a, r.offset) for r in got if r.vshard == v)
        assert [o for _, o in own] == [i + (100 if v == 1 else 0) for i in range(len(own))]


def test_gauges_of_a_two_message_log(spark):
    m = spark.createDataFrame([("s", 0, 0, NOW), ("s", 0, 1, NOW)], MSG)
    state = spark.createDataFrame([("s", 0, "fast", 2), ("s", 0, "slow", 0)], "stream string, vshard int, consumer_group string, committed_watermark long")
    depth = {r.consumer_group: r.depth for r in metrics.queue_depth(state, log.next_offset(m)).collect()}
    age = {r.consumer_group: r.age_seconds for r in metrics.oldest_unacked_age(state, m, F.lit(NOW + timedelta(seconds=3))).collect()}
    blocked = {r.consumer_group: r.blocked for r in metrics.pruning_blocked(state, F.lit(True)).collect()}
    assert depth == {"fast": 0, "slow": 2} and age == {"fast": 0.0, "slow": 3.0} and blocked == {"fast": 0, "slow": 1}


def test_reshard_copies_until_caught_up(spark):
    m = spark.createDataFrame([("s", 0, i, NOW) for i in range(4)], MSG)
    target = spark.createDataFrame([], MSG)
    first = retention.reshard_copy(m, 0, target, "s", 1, F.lit(NOW)).orderBy("offset").collect()
    assert [(r.source_offset, r.offset) for r in first] == [(i, i) for i in range(4)]
    step = retention.reshard_progress(m, 0).first()
    assert (step.next_offset, step.caught_up) == (4, False)
    last = retention.reshard_progress(m, 4).first()
    assert (last.next_offset, last.caught_up) == (4, True)


def test_replay_and_term_lookup(spark):
    wal = spark.createDataFrame([(i, i // 3) for i in range(1, 9)], "raft_index long, raft_term long")
    assert log.term_at(wal, 7).first().raft_term == 2 and log.term_at(wal, 0, (0, 5)).first().raft_term == 5
    with pytest.raises(Exception, match="no record at index 99"):
        log.term_at(wal, 99).collect()
    state = spark.createDataFrame([("s", 0, 2)], "stream string, vshard int, next_offset long")
    m = spark.createDataFrame([("s", 0, i, NOW) for i in range(4)] + [("s", 1, 0, NOW)], MSG)
    assert log.beyond_applied(m, state).count() == 3
