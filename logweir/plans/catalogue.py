"""Registered queries over the log operators, each with the SQL that must agree."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._ship import ensure_importable
from ..functions import hashing, scalars
from ..operators import acks, compaction, control, log, metrics, policy, retention
from ..schema import GROUP, SHARD
from ..sources import codec
from . import bridge as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_M = """m AS (SELECT 'events' AS stream, CAST(user_id % 4 AS INT) AS vshard, ROW_NUMBER() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS off,
  ts, CAST(user_id AS VARCHAR) AS key, props, event_type, event_id,
  CAST(48 + octet_length(encode(CAST(user_id AS VARCHAR))) + coalesce(octet_length(encode(event_type)), 0) + CASE WHEN props IS NULL THEN 0 ELSE 5 + octet_length(encode(props)) END AS BIGINT) AS bytes
  FROM events)"""
_A = _M + """, g(grp, k, mand) AS (VALUES ('fast', 1000000, true), ('mid', 50, true), ('slow', 20, false)),
  a AS (SELECT DISTINCT grp, mand, stream, vshard, off FROM m, g WHERE off % k <> k - 1)"""
_W = _A + """, wm AS (SELECT grp, mand, stream, vshard, CAST(COUNT(*) FILTER (WHERE off = rn) AS BIGINT) AS wm
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY grp, vshard ORDER BY off) - 1 AS rn FROM a) GROUP BY ALL),
  nx AS (SELECT vshard, MAX(off) + 1 AS nx FROM m GROUP BY 1)"""
_GATE = _W + ", gate AS (SELECT vshard, coalesce(min(wm) FILTER (WHERE mand), 0) AS gate FROM wm GROUP BY 1)"
_S = _M + """, seg AS (SELECT stream, vshard, off // 50 AS segment, MIN(off) AS min_offset, MAX(off) AS max_offset, CAST(SUM(bytes) AS BIGINT) AS bytes, MAX(ts) AS written_at FROM m GROUP BY ALL)"""
_NOW = f"TIMESTAMP '{b.NOW}'"
_CUT = f"make_timestamp(epoch_us({_NOW}) - {b.MAX_US})"
_OA = "oa AS (SELECT DISTINCT l_returnflag AS grp, l_orderkey AS off FROM lineitem)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_importable(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query(f"WITH {_M} SELECT vshard, off AS \"offset\", event_id FROM m")
def assign_offsets(spark, d):
    return b.messages(spark, d).select("vshard", "offset", "event_id")


@query(f"WITH {_M} SELECT vshard, off AS \"offset\", key, event_id FROM m WHERE off = 42")
def point_lookup(spark, d):
    return log.point_lookup(b.messages(spark, d), 42).select("vshard", "offset", F.decode("partition_key", "UTF-8").alias("key"), "event_id")


@query(f"WITH {_M} SELECT vshard, off AS \"offset\", event_id FROM m WHERE off >= 100 ORDER BY vshard, off")
def range_scan(spark, d):
    return log.range_scan(b.messages(spark, d), 100).select("vshard", "offset", "event_id")


@query(f"WITH {_M} SELECT vshard, CAST(greatest(7, max(off) + 1) AS BIGINT) AS next_offset FROM m GROUP BY 1")
def next_offset(spark, d):
    return log.next_offset(b.messages(spark, d), floor=7).select("vshard", "next_offset")


@query("SELECT l_orderkey AS \"offset\", min(l_linenumber) AS delivery FROM lineitem GROUP BY 1")
def replay_dedup(spark, d):
    rows = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("offset"), F.col("l_linenumber").alias("delivery"))
    return log.replay_dedup(rows, ["offset"], "delivery")


_WAL = "CASE WHEN event_id % 3 = 0 THEN 'Append' WHEN event_id % 3 = 1 THEN 'Ack' ELSE 'AckCheckpoint' END"


def _wal(spark, d):
    n = F.col("event_id") % 3
    kind = F.when(n == 0, "Append").when(n == 1, "Ack").otherwise("AckCheckpoint")
    return b.unnumbered(spark, d).select(kind.alias("record_type"), F.floor(F.col("event_id") / 100).alias("raft_term"), F.col("event_id").alias("raft_index"), "ts", "partition_key", "headers", "payload")


@query(f"SELECT {_WAL} AS record_type, event_id AS raft_index FROM events WHERE event_id % 3 = 0 UNION ALL SELECT {_WAL}, event_id FROM events WHERE event_id % 3 <> 0")
def record_type_filter(spark, d):
    w = _wal(spark, d)
    return log.appends_only(w).unionByName(log.acks_only(w)).select("record_type", "raft_index")


@query("SELECT event_id AS raft_index, event_id // 100 AS raft_term FROM events WHERE event_id >= 250 ORDER BY 1")
def wal_scan(spark, d):
    return log.wal_from(_wal(spark, d), 250).select("raft_index", "raft_term")


@query("SELECT event_id // 100 AS raft_term FROM events WHERE event_id = 321")
def term_lookup(spark, d):
    return log.term_at(_wal(spark, d), 321)


@query("SELECT event_id AS raft_index FROM events WHERE event_id < 700")
def truncate_log(spark, d):
    return log.truncate_from(_wal(spark, d), 700).select("raft_index")


@query("""WITH loc AS (SELECT event_id AS i, event_id // 100 AS t FROM events WHERE event_id < 600), inc AS (SELECT event_id AS i, CASE WHEN event_id >= 450 THEN 99 ELSE event_id // 100 END AS t FROM events WHERE event_id >= 300),
  c AS (SELECT coalesce(min(loc.i) FILTER (WHERE loc.t <> inc.t), (SELECT max(i) + 1 FROM loc)) AS cut FROM loc JOIN inc USING (i))
  SELECT i AS raft_index, CAST(t AS BIGINT) AS raft_term FROM loc, c WHERE i < cut UNION ALL SELECT i, CAST(t AS BIGINT) FROM inc, c WHERE i >= cut""")
def append_entries_merge(spark, d):
    w = _wal(spark, d).select("raft_index", "raft_term")
    incoming = w.where("raft_index >= 300").withColumn("raft_term", F.when(F.col("raft_index") >= 450, F.lit(99).cast("long")).otherwise(F.col("raft_term")))
    return log.merge_entries(log.truncate_from(w, 600), incoming)


@query("SELECT min(event_id) AS conflict_index FROM events WHERE event_id // 100 = (SELECT event_id // 100 FROM events WHERE event_id = 555)")
def conflict_index(spark, d):
    return log.conflict_index(_wal(spark, d), 555)


@query(f"WITH {_M} SELECT vshard, off AS \"offset\", off >= 150 AS unflushed FROM m")
def segments_union_memtable(spark, d):
    m = b.messages(spark, d)
    flushed, buffer = m.where("offset < 150").withColumn("unflushed", F.lit(False)), m.where("offset >= 150").withColumn("unflushed", F.lit(True))
    return log.segments_then_buffer(flushed, buffer).select("vshard", "offset", "unflushed")


@query(f"WITH {_S} SELECT vshard, CAST(segment AS BIGINT) AS segment, min_offset, max_offset, bytes, max_offset - min_offset + 1 AS messages FROM seg")
def segment_stats(spark, d):
    return b.segments(spark, d).select("vshard", "segment", "min_offset", "max_offset", "bytes", "messages")


@query("WITH RECURSIVE " + _M + """, r AS (SELECT vshard, off, bytes AS held, CAST(0 AS BIGINT) AS segment FROM m WHERE off = 0
    UNION ALL SELECT m.vshard, m.off, CASE WHEN r.held >= 6000 THEN m.bytes ELSE r.held + m.bytes END, CASE WHEN r.held >= 6000 THEN r.segment + 1 ELSE r.segment END FROM r JOIN m ON m.vshard = r.vshard AND m.off = r.off + 1)
  SELECT vshard, off AS "offset", segment FROM r""")
def flush_segments(spark, d):
    return log.flush_segments(log.with_size(b.messages(spark, d)), 6000).select("vshard", "offset", "segment")


@query(f"""WITH {_M}, r AS (SELECT vshard, off, off // 50 AS segment, bytes, ROW_NUMBER() OVER w AS rn, SUM(bytes) OVER w - bytes AS pos FROM m WINDOW w AS (PARTITION BY vshard, off // 50 ORDER BY off))
  SELECT vshard, CAST(segment AS BIGINT) AS segment, off AS "offset", CAST(pos AS BIGINT) AS position FROM r WHERE rn % 16 = 1""")
def sparse_index(spark, d):
    rows = log.with_size(b.messages(spark, d)).withColumn("segment", F.floor(F.col("offset") / b.SEGMENT_ROWS))
    return log.sparse_index(rows, every=16).select("vshard", "segment", "offset", "position")


@query(f"""WITH {_M}, r AS (SELECT vshard, off, off // 50 AS segment, ROW_NUMBER() OVER w AS rn, SUM(bytes) OVER w - bytes AS pos FROM m WINDOW w AS (PARTITION BY vshard, off // 50 ORDER BY off))
  SELECT vshard, CAST(segment AS BIGINT) AS segment, CAST(coalesce(arg_max(pos, off) FILTER (WHERE off <= 130), 0) AS BIGINT) AS position FROM r WHERE rn % 16 = 1 GROUP BY 1, 2""")
def segment_seek(spark, d):
    rows = log.with_size(b.messages(spark, d)).withColumn("segment", F.floor(F.col("offset") / b.SEGMENT_ROWS))
    return log.seek(log.sparse_index(rows, every=16), 130).select("vshard", "segment", "position")


@query(f"WITH {_S} SELECT vshard, min_offset, max_offset, min_offset <= 120 AS covers FROM seg WHERE max_offset >= 120")
def segment_range_prune(spark, d):
    s = log.prune_segments(b.segments(spark, d), 120)
    covering = log.covering_segments(s, 120).select(*SHARD, "segment", F.lit(True).alias("c"))
    return s.join(covering, [*SHARD, "segment"], "left").select("vshard", "min_offset", "max_offset", F.coalesce("c", F.lit(False)).alias("covers"))


@query("SELECT c_custkey, CAST(('0x' || substr(md5(c_name), 1, 8))::UBIGINT % 1024 AS INT) AS vshard FROM customer")
def route_md5(spark, d):
    return b.table(spark, d, "customer").select("c_custkey", hashing.route_md5(F.encode("c_name", "UTF-8"), F.lit(1024)).alias("vshard"))


@query()
def route_xxh3(spark, d):
    return b.table(spark, d, "customer").select("c_custkey", hashing.route_xxh3(F.encode("c_name", "UTF-8"), F.lit(1024)).alias("vshard"))


@query("""SELECT c_custkey, CAST(c_custkey % 1024 AS INT) AS vshard, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || '-' || substr(h, 11, 2) || substr(h, 9, 2) || '-' || substr(h, 15, 2) || substr(h, 13, 2) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS migration_id
  FROM (SELECT c_custkey, sha256(c_name || ':' || (c_custkey % 1024) || ':bootstrap') AS h FROM customer)""")
def bootstrap_ids(spark, d):
    shard = F.col("c_custkey") % 1024
    return b.table(spark, d, "customer").select("c_custkey", shard.cast("int").alias("vshard"), hashing.bootstrap_id_column(F.col("c_name"), shard).alias("migration_id"))


@query(f"WITH {_W} SELECT grp AS consumer_group, vshard, wm AS low_watermark FROM wm")
def low_watermark(spark, d):
    return acks.low_watermark(b.acked(spark, d)).select("consumer_group", "vshard", "low_watermark")


@query(f"""WITH {_OA}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY off) - 1 AS rn FROM oa)
  SELECT grp AS consumer_group, CAST(COUNT(*) FILTER (WHERE off = rn) AS BIGINT) AS low_watermark FROM r GROUP BY 1""")
def order_watermark(spark, d):
    return acks.low_watermark(b.order_acks(spark, d)).select("consumer_group", "low_watermark")


@query(f"WITH {_W} SELECT grp AS consumer_group, vshard, off AS \"offset\" FROM a JOIN wm USING (grp, vshard) WHERE off >= wm")
def selective_acks(spark, d):
    a = b.acked(spark, d)
    return acks.selective(a, acks.low_watermark(a)).select("consumer_group", "vshard", "offset")


@query(f"WITH {_W} SELECT wm.grp AS consumer_group, vshard, m.off AS \"offset\", m.off < wm OR a.off IS NOT NULL AS acked FROM wm JOIN m USING (vshard) LEFT JOIN a USING (grp, vshard, off)")
def is_acked(spark, d):
    a = b.acked(spark, d)
    return acks.is_acked(b.messages(spark, d).select(*SHARD, "offset"), a, acks.low_watermark(a)).select("consumer_group", "vshard", "offset", "acked")


@query(f"WITH {_OA} SELECT grp AS consumer_group, off AS \"offset\" FROM oa WHERE off < (SELECT count(*) // 2 FROM orders)")
def within_log_bounds(spark, d):
    bounds = b.order_log(spark, d).groupBy(*SHARD).agg(F.floor(F.count(F.lit(1)) / 2).alias("next_offset"))
    return acks.within_log_bounds(b.order_acks(spark, d), bounds).select("consumer_group", "offset").distinct()


@query(f"""WITH {_W}, c AS (SELECT grp, vshard, off FROM a WHERE off % 2 = 0 OR off < 30), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY grp, vshard ORDER BY off) - 1 AS rn FROM c),
  cw AS (SELECT grp, vshard, CAST(COUNT(*) FILTER (WHERE off = rn) AS BIGINT) AS cw FROM r GROUP BY 1, 2) SELECT grp AS consumer_group, vshard, wm AS low_watermark, cw AS committed_watermark FROM wm JOIN cw USING (grp, vshard)""")
def committed_vs_applied(spark, d):
    events = b.acked(spark, d).select(F.col("offset").alias("seq"), *GROUP, F.when((F.col("offset") % 2 == 0) | (F.col("offset") < 30), "ack").otherwise("local").alias("kind"), F.array("offset").alias("offsets"), F.lit(None).cast("long").alias("watermark"))
    return acks.fold_acks(events).select("consumer_group", "vshard", "low_watermark", "committed_watermark")


@query(f"WITH {_W} SELECT vshard, min(wm) AS watermark FROM wm GROUP BY 1")
def all_groups_watermark(spark, d):
    return acks.all_groups_watermark(b.state(spark, d)).select("vshard", "watermark")


@query(f"WITH {_GATE} SELECT vshard, gate AS watermark FROM gate")
def mandatory_watermark(spark, d):
    return acks.mandatory_watermark(b.state(spark, d), F.col("mandatory")).select("vshard", "watermark")


@query(f"WITH {_W} SELECT vshard, arg_min(grp, (wm, grp)) FILTER (WHERE mand) AS slowest FROM wm GROUP BY 1")
def slowest_mandatory_group(spark, d):
    return acks.slowest_mandatory(b.state(spark, d), F.col("mandatory")).select("vshard", "slowest")


@query(f"WITH {_A} SELECT DISTINCT vshard, grp AS consumer_group FROM a UNION SELECT DISTINCT vshard, 'opened' FROM m")
def registered_groups(spark, d):
    opened = b.messages(spark, d).select(*SHARD, F.lit("opened").alias("consumer_group"))
    return acks.registered_groups(b.acked(spark, d), opened).select("vshard", "consumer_group")


@query(f"WITH {_W} SELECT vshard, off AS \"offset\", event_id FROM m JOIN wm USING (vshard) WHERE grp = 'mid' AND off >= wm")
def consume_from_watermark(spark, d):
    from ..streaming.live import consume

    return consume(b.messages(spark, d), b.state(spark, d), "mid").select("vshard", "offset", "event_id")


@query(f"WITH {_W} SELECT grp AS consumer_group, vshard, nx - wm AS depth FROM wm JOIN nx USING (vshard)")
def queue_depth(spark, d):
    bounds = log.next_offset(b.messages(spark, d))
    return metrics.queue_depth(b.state(spark, d), bounds).select("consumer_group", "vshard", "depth")


@query(f"WITH {_W} SELECT grp AS consumer_group, wm.vshard, coalesce(greatest(0, epoch_us({_NOW}) - epoch_us(ts)) / 1e6, 0.0) AS age_seconds FROM wm LEFT JOIN m ON m.vshard = wm.vshard AND m.off = wm")
def oldest_unacked_age(spark, d):
    return metrics.oldest_unacked_age(b.state(spark, d), b.messages(spark, d), b.now()).select("consumer_group", "vshard", "age_seconds")


@query(f"WITH {_W}, s AS (SELECT vshard, arg_min(grp, (wm, grp)) FILTER (WHERE mand) AS slow FROM wm GROUP BY 1) SELECT grp AS consumer_group, vshard, CAST(grp = slow AS INT) AS blocked FROM wm JOIN s USING (vshard)")
def pruning_blocked(spark, d):
    return metrics.pruning_blocked(b.state(spark, d), F.col("mandatory")).select("consumer_group", "vshard", "blocked")


@query(f"WITH {_M} SELECT stream, 'g' || (vshard % 2) AS group_id, count(*) AS messages FROM m GROUP BY 1, 2")
def ingest_total(spark, d):
    m = b.messages(spark, d)
    placed = m.select(*SHARD).distinct().withColumn("group_id", F.concat(F.lit("g"), (F.col("vshard") % 2).cast("string")))
    return metrics.ingest_total(m, placed)


@query("SELECT l_returnflag AS consumer_group, count(*) AS acks FROM lineitem GROUP BY 1")
def ack_total(spark, d):
    a = b.order_acks(spark, d).withColumns({"kind": F.lit("ack"), "offsets": F.array("offset")})
    return metrics.ack_total(a).select("consumer_group", "acks")


@query("""WITH l AS (SELECT greatest(0, epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6 AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  SELECT 0 AS vshard, count(*) AS acks, sum(s) AS seconds, count(*) FILTER (WHERE s <= 0.1) AS le_0, count(*) FILTER (WHERE s <= 1) AS le_1, count(*) FILTER (WHERE s <= 10) AS le_2, count(*) FILTER (WHERE s <= 60) AS le_3, count(*) FILTER (WHERE s <= 3600) AS le_4, count(*) FILTER (WHERE s <= 86400) AS le_5 FROM l""")
def ack_latency(spark, d):
    return metrics.ack_latency(b.order_acks(spark, d), b.order_log(spark, d)).drop("stream")


@query(f"WITH {_M} SELECT vshard, off AS \"offset\", date_trunc('millisecond', ts) <= {_CUT} AS expired FROM m")
def retention_cutoff(spark, d):
    return retention.past_retention(b.messages(spark, d), b.now(), F.lit(b.MAX_US)).select("vshard", "offset", "expired")


_STOP = _GATE + f", st AS (SELECT m.vshard, gate, min(off) FILTER (WHERE off >= gate AND date_trunc('millisecond', ts) > {_CUT}) AS stop, max(off) + 1 AS e FROM m JOIN gate USING (vshard) GROUP BY 1, 2)"


def _stops(spark, d):
    return retention.retention_stops(b.messages(spark, d), b.gates(spark, d), b.now(), F.lit(b.MAX_US))


@query(f"WITH {_STOP} SELECT 'events.__deadletter__' AS stream, m.vshard, off AS \"offset\", event_id FROM m JOIN st USING (vshard) WHERE off >= gate AND off < coalesce(stop, e)")
def dead_letter_forward(spark, d):
    return retention.dead_letters(b.messages(spark, d), _stops(spark, d)).select("stream", "vshard", "offset", "event_id")


@query(f"WITH {_STOP} SELECT vshard, coalesce(stop, e) AS safe_to_prune FROM st")
def safe_to_prune(spark, d):
    return retention.safe_to_prune(_stops(spark, d)).select("vshard", "safe_to_prune")


@query(f"WITH {_STOP} SELECT m.vshard, count(*) AS messages FROM m JOIN st USING (vshard) WHERE off >= gate AND off < coalesce(stop, e) GROUP BY 1")
def dead_letter_total(spark, d):
    return metrics.dead_letter_total(retention.dead_letters(b.messages(spark, d), _stops(spark, d))).select("vshard", "messages")


@query(f"WITH {_GATE}, s AS (SELECT vshard, off // 50 AS seg, min(off) AS min_offset, max(off) AS max_offset FROM m GROUP BY 1, 2) SELECT vshard, min_offset, max_offset FROM s JOIN gate USING (vshard) WHERE max_offset < gate")
def prunable_segments(spark, d):
    return retention.prunable_segments(b.segments(spark, d), b.gates(spark, d)).select("vshard", "min_offset", "max_offset")


_FLOOR = _S + """, l AS (SELECT *, min_offset % 150 <> 0 AS ok, sum(bytes) OVER (PARTITION BY vshard) - coalesce(sum(CASE WHEN min_offset % 150 <> 0 THEN bytes ELSE 0 END) OVER (PARTITION BY vshard ORDER BY min_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM seg),
  pr AS (SELECT * FROM l WHERE remaining > 20000 AND ok)"""


def _pruned(spark, d):
    return retention.size_floor_prune(b.segments(spark, d), 20_000, F.col("min_offset") % 150 != 0)


@query(f"WITH {_FLOOR} SELECT vshard, min_offset, max_offset, bytes FROM pr")
def size_floor_prune(spark, d):
    return _pruned(spark, d).select("vshard", "min_offset", "max_offset", "bytes")


@query(f"WITH {_FLOOR} SELECT vshard, CAST(sum(max_offset - min_offset + 1) AS BIGINT) AS messages FROM pr GROUP BY 1")
def forced_prune_total(spark, d):
    return metrics.forced_prune_total(_pruned(spark, d)).select("vshard", "messages")


@query(f"WITH {_S} SELECT vshard, min_offset, max_offset FROM seg WHERE epoch_us({_NOW}) - epoch_us(written_at) >= {20 * 86_400_000_000}")
def compaction_candidates(spark, d):
    return compaction.candidates(b.segments(spark, d), b.now(), 20 * 86_400_000_000).select("vshard", "min_offset", "max_offset")


_PACK = "WITH RECURSIVE " + _S + """, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY vshard ORDER BY min_offset) AS i FROM seg),
  r AS (SELECT vshard, i, min_offset, max_offset, bytes, 0 AS g, bytes AS held FROM n WHERE i = 1
    UNION ALL SELECT n.vshard, n.i, n.min_offset, n.max_offset, n.bytes, CASE WHEN r.held + n.bytes > 12000 THEN r.g + 1 ELSE r.g END, CASE WHEN r.held + n.bytes > 12000 THEN n.bytes ELSE r.held + n.bytes END FROM r JOIN n ON n.vshard = r.vshard AND n.i = r.i + 1)"""


def _groups(spark, d):
    return compaction.merge_groups(b.segments(spark, d), 12_000)


@query(_PACK + " SELECT vshard, min_offset, max_offset, CAST(g AS INT) AS merge_group FROM r")
def compaction_groups(spark, d):
    return _groups(spark, d).select("vshard", "min_offset", "max_offset", "merge_group")


_PLAN = _PACK + """, f AS (SELECT vshard, min(g) AS g FROM (SELECT vshard, g FROM r GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1), p AS (SELECT r.* FROM r JOIN f USING (vshard, g))"""


@query(_PLAN + " SELECT vshard, min_offset, max_offset FROM p")
def compaction_plan(spark, d):
    return compaction.first_plan(_groups(spark, d)).select("vshard", "min_offset", "max_offset")


@query(_PLAN + " SELECT vshard, min_offset, max_offset, bytes FROM r WHERE (vshard, min_offset) NOT IN (SELECT vshard, min_offset FROM p) UNION ALL SELECT vshard, min(min_offset), max(max_offset), CAST(sum(bytes) AS BIGINT) FROM p GROUP BY vshard")
def compaction_replace(spark, d):
    plan = compaction.first_plan(_groups(spark, d))
    merged = compaction.merged_segments(plan).drop("merge_group")
    held = b.segments(spark, d).select(*SHARD, "min_offset", "max_offset", "bytes")
    return compaction.replace_in(held, plan, merged).drop("stream")


@query("""WITH RECURSIVE n AS (SELECT user_id, event_id, ts, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
  p AS (SELECT user_id AS u, event_id AS seq, epoch_us(ts) AS us, i, i * (1 + i % 3) AS wm FROM n),
  r AS (SELECT u, seq, i, wm, true AS due, wm AS mark, us AS at FROM p WHERE i = 1
    UNION ALL SELECT p.u, p.seq, p.i, p.wm, p.wm > r.mark AND (p.wm - r.mark >= 5 OR p.us - r.at >= 3600000000), CASE WHEN p.wm > r.mark AND (p.wm - r.mark >= 5 OR p.us - r.at >= 3600000000) THEN p.wm ELSE r.mark END,
      CASE WHEN p.wm > r.mark AND (p.wm - r.mark >= 5 OR p.us - r.at >= 3600000000) THEN p.us ELSE r.at END FROM r JOIN p ON p.u = r.u AND p.i = r.i + 1)
  SELECT CAST(u AS VARCHAR) AS consumer_group, seq, CAST(wm AS BIGINT) AS low_watermark, due FROM r""")
def checkpoint_due(spark, d):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = b.table(spark, d, "events").withColumn("i", i)
    p = e.select(F.lit("events").alias("stream"), F.lit(0).alias("vshard"), F.col("user_id").cast("string").alias("consumer_group"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), (F.col("i") * (1 + F.col("i") % 3)).cast("long").alias("low_watermark"))
    return compaction.checkpoint_due(p, 3_600_000_000, 5).select("consumer_group", "seq", "low_watermark", "due")


_CTL = """c AS (SELECT o_orderkey AS version, CASE WHEN o_orderkey % 4 < 2 THEN 'S' WHEN o_orderkey % 4 = 2 THEN 'C' ELSE 'A' END AS t, 'm' || (o_custkey % 7) AS id, o_custkey % 64 AS v, 'g' || (o_orderkey % 5) AS src, 'g' || (o_orderkey % 3) AS dst,
  ROW_NUMBER() OVER (PARTITION BY o_custkey % 64 ORDER BY o_orderkey) AS i FROM orders)"""


@query(f"""WITH RECURSIVE {_CTL}, r AS (SELECT v, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS g, CAST(NULL AS VARCHAR) AS target, CAST(NULL AS VARCHAR) AS mid FROM (SELECT DISTINCT v FROM c)
    UNION ALL SELECT c.v, c.i,
      CASE WHEN t = 'S' AND mid IS DISTINCT FROM id AND target IS NULL THEN src WHEN t = 'C' AND mid = id THEN dst ELSE g END,
      CASE WHEN t = 'S' AND mid IS DISTINCT FROM id AND target IS NULL THEN dst WHEN t <> 'S' AND mid = id THEN NULL ELSE target END,
      CASE WHEN t = 'S' AND mid IS DISTINCT FROM id AND target IS NULL THEN id WHEN t = 'A' AND mid = id THEN NULL ELSE mid END FROM r JOIN c ON c.v = r.v AND c.i = r.i + 1),
  z AS (SELECT v, arg_max(struct_pack(g := g, t := target, m := mid), i) AS s FROM r GROUP BY v)
  SELECT CAST(v AS INT) AS vshard, s.g AS group_id, s.t AS migrating_to, s.m AS migration_id FROM z WHERE s.g IS NOT NULL""")
def fold_assignments(spark, d):
    return control.assignments(b.control_log(spark, d)).drop("stream")


_SET = """s AS (SELECT o_orderkey AS version, o_orderkey % 7 AS t, 's' || (o_custkey % 20) AS stream, 'c' || (o_orderkey // 7 % 5) AS grp, 'u' || (o_orderkey // 7 % 11) AS subject, CAST(floor(o_totalprice) AS BIGINT) % 50 + 1 AS q FROM orders)"""


@query(f"""WITH {_SET} SELECT stream, grp AS consumer_group, coalesce(arg_max(CASE WHEN q % 2 = 0 THEN 'Strict' ELSE 'Checkpoint' END, version) FILTER (WHERE t = 0), 'Strict') AS mode, coalesce(arg_max(q % 3 <> 0, version) FILTER (WHERE t = 1), true) AS mandatory FROM s WHERE t < 2 GROUP BY 1, 2""")
def fold_policies(spark, d):
    return control.group_policies(b.settings_log(spark, d))


@query(f"""WITH {_SET}, p AS (SELECT stream, arg_max(q, version) FILTER (WHERE t = 2) AS q, arg_max(q, version) FILTER (WHERE t = 3) AS k FROM s WHERE t IN (2, 3) GROUP BY 1)
  SELECT stream, coalesce(greatest((q - 5) * 1000, 0), 604800000000) AS audit_us, coalesce(greatest(q * 2000, 0), 2592000000000) AS max_us, CASE WHEN q % 4 <> 0 AND q - 10 >= 0 THEN q - 10 END AS max_bytes,
  CASE WHEN k % 5 <> 0 THEN k * 100 END AS checkpoint_us, CAST(CASE WHEN k % 3 <> 0 THEN k END AS INT) AS checkpoint_count FROM p""")
def fold_retention_policies(spark, d):
    return control.retention_policies(b.settings_log(spark, d))


@query(f"""WITH {_SET}, p AS (SELECT subject, stream, arg_max(q % 2 = 0, version) AS ok FROM s WHERE t = 4 GROUP BY 1, 2), c AS (SELECT subject, stream, grp, arg_max(q % 2 = 0, version) AS ok FROM s WHERE t = 5 GROUP BY 1, 2, 3),
  ask AS (SELECT DISTINCT 'u' || (c_custkey % 13) AS subject, 's' || (c_custkey % 23) AS stream, 'c' || (c_custkey % 6) AS grp FROM customer)
  SELECT ask.subject, ask.stream, ask.grp AS consumer_group, coalesce(p.ok, false) AS can_produce, coalesce(c.ok, false) AS can_consume FROM ask LEFT JOIN p USING (subject, stream) LEFT JOIN c USING (subject, stream, grp)""")
def acl_check(spark, d):
    s, k = b.settings_log(spark, d), F.col("c_custkey")
    name = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    ask = b.table(spark, d, "customer").select(name("u", 13).alias("subject"), name("s", 23).alias("stream"), name("c", 6).alias("consumer_group")).distinct()
    out = policy.can_produce(ask, control.produce_acl(s)).withColumnRenamed("allowed", "can_produce")
    return policy.can_consume(out, control.consume_acl(s)).withColumnRenamed("allowed", "can_consume")


@query(f"""WITH {_SET}, o AS (SELECT stream, arg_max(struct_pack(c := CASE WHEN q % 2 = 0 THEN 'claim' || (q % 3) END), version).c AS claim FROM s WHERE t = 6 GROUP BY 1)
  SELECT c_custkey, CASE coalesce(claim, 'sub') WHEN 'sub' THEN c_name WHEN 'claim1' THEN c_mktsegment END AS subject FROM customer LEFT JOIN o ON o.stream = 's' || (c_custkey % 23)""")
def subject_claim(spark, d):
    claims = F.create_map(F.lit("sub"), F.col("c_name"), F.lit("claim1"), F.col("c_mktsegment"))
    ask = b.table(spark, d, "customer").select("c_custkey", F.concat(F.lit("s"), (F.col("c_custkey") % 23).cast("string")).alias("stream"), claims.alias("claims"))
    return policy.subject(ask, control.claim_overrides(b.settings_log(spark, d)), "sub").select("c_custkey", "subject")


@query("""SELECT o_orderkey AS version, CASE WHEN o_orderkey % 4 < 2 THEN 'MigrationStarted' WHEN o_orderkey % 4 = 2 THEN 'Cutover' ELSE 'MigrationAborted' END AS record_type,
  'MigrationId=m' || (o_custkey % 7) || ';StreamName=orders;VirtualShardIndex=' || (o_custkey % 64) || ';FromGroupId=g' || (o_orderkey % 5) || ';ToGroupId=g' || (o_orderkey % 3) AS fields,
  epoch_us(o_orderdate) AS timestamp_micros, CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE o_orderpriority END AS proposed_by FROM orders""")
def audit_describe(spark, d):
    listed = F.concat_ws(";", F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return control.describe(b.control_log(spark, d)).withColumn("fields", listed)


@query("SELECT CAST(count(*) AS BIGINT) AS records, min(o_orderkey) AS first_version, max(o_orderkey) AS last_version FROM orders WHERE o_orderkey >= 17")
def watch_from(spark, d):
    seen = control.watch(control.newer(b.control_log(spark, d), None), 17)
    return seen.agg(F.count(F.lit(1)).alias("records"), F.min("version").alias("first_version"), F.max("version").alias("last_version"))


@query("""WITH a AS (SELECT DISTINCT c_mktsegment || CASE WHEN c_custkey % 5 = 0 THEN '.__deadletter__' ELSE '' END AS stream, 'g' || (c_custkey % 9) AS group_id FROM customer)
  SELECT group_id, coalesce(min(stream) FILTER (WHERE NOT ends_with(stream, '.__deadletter__')), min(stream)) AS stream FROM a GROUP BY 1""")
def primary_stream(spark, d):
    name = F.when(F.col("c_custkey") % 5 == 0, scalars.dead_letter_name(F.col("c_mktsegment"))).otherwise(F.col("c_mktsegment"))
    return control.primary_stream(b.table(spark, d, "customer").select(name.alias("stream"), F.concat(F.lit("g"), (F.col("c_custkey") % 9).cast("string")).alias("group_id")))


@query("""WITH s AS (SELECT c_mktsegment AS stream, CAST(CASE WHEN c_mktsegment < 'C' THEN 16 ELSE 17 END AS INT) AS n, c_custkey % 16 AS v FROM customer)
  SELECT stream, count(DISTINCT v) = max(n) AND min(v) = 0 AND max(v) = max(n) - 1 AS covered FROM s GROUP BY 1""")
def covers_every_index(spark, d):
    c = b.table(spark, d, "customer").select(F.col("c_mktsegment").alias("stream"), (F.col("c_custkey") % 16).alias("vshard"))
    streams = c.groupBy("stream").agg(F.when(F.col("stream") < "C", 16).otherwise(17).alias("vshards"))
    return control.covers_every_index(c, streams)


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) > 65535 THEN 'partition key too long' END AS error FROM documents")
def validate_request(spark, d):
    empty = F.array().cast("array<struct<key:binary,value:binary>>")
    return b.table(spark, d, "documents").select("doc_id", scalars.request_error(F.encode("text", "UTF-8"), empty).alias("error"))


@query("""WITH n AS (SELECT 'g' || n_regionkey AS group_id, n_nationkey, lower(n_name) AS address FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000))
  SELECT group_id, CAST(min(n_nationkey) AS VARCHAR) AS node_id, arg_min(address, n_nationkey) AS address FROM n GROUP BY 1""")
def group_redirect(spark, d):
    return policy.redirects(*b.nodes(spark, d))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment < 'C' THEN NULL WHEN c_custkey % 16 >= 12 THEN NULL ELSE 'g' || (c_custkey % 16 % 5) END AS group_id,
  CASE WHEN c_mktsegment < 'C' THEN 'NotFound' WHEN c_custkey % 16 >= 12 THEN 'Unavailable' END AS error FROM customer""")
def resolve_group(spark, d):
    rows = b.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("stream"), (F.col("c_custkey") % 16).cast("int").alias("vshard"))
    streams = rows.select("stream").distinct().where(F.col("stream") >= "C")
    placed = rows.select(*SHARD).distinct().where("vshard < 12").withColumn("group_id", F.concat(F.lit("g"), (F.col("vshard") % 5).cast("string")))
    return policy.resolve(rows, streams, placed).select("c_custkey", "group_id", "error")


@query(f"WITH {_GATE} SELECT wm.grp AS consumer_group, vshard, CASE WHEN grp = 'slow' THEN 'Checkpoint' ELSE 'Strict' END AS mode, grp <> 'slow' AS mandatory FROM wm")
def policy_defaults(spark, d):
    s = b.state(spark, d).select(*GROUP)
    known = spark.createDataFrame([("events", "slow", "Checkpoint", False)], "stream string, consumer_group string, mode string, mandatory boolean")
    return policy.with_group_policy(s, known).drop("stream")


@query(f"WITH {_M} SELECT 'copy' AS stream, off AS source_offset, 100 + off - 30 AS \"offset\", event_id FROM m WHERE vshard = 1 AND off >= 30")
def reshard_copy(spark, d):
    source = b.messages(spark, d).where("vshard = 1")
    target = spark.createDataFrame([("copy", 0, 99)], "stream string, vshard int, offset long")
    return retention.reshard_copy(source, 30, target, "copy", 0, b.now()).select("stream", "source_offset", "offset", "event_id")


@query(f"WITH {_M} SELECT coalesce(max(off) + 1, 120) AS next_offset, coalesce(max(off) + 1, 120) = 120 AS caught_up FROM m WHERE vshard = 1 AND off >= 120")
def reshard_progress(spark, d):
    return retention.reshard_progress(b.messages(spark, d).where("vshard = 1"), 120)


@query(f"WITH {_M} SELECT vshard, count(*) AS messages FROM m WHERE vshard % 2 <> 1 GROUP BY 1")
def admission_gate(spark, d):
    m = b.messages(spark, d).withColumn("group_id", F.concat(F.lit("g"), (F.col("vshard") % 2).cast("string")))
    paused = spark.createDataFrame([("g1",)], "group_id string")
    return retention.admitted(m, paused).groupBy("vshard").agg(F.count(F.lit(1)).alias("messages"))


@query("""WITH k AS (SELECT n_regionkey, list_sort(list(s), 'DESC') AS l FROM (SELECT n_regionkey, n_nationkey, count(s_suppkey) * 100 AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1)
  SELECT 'g' || n_regionkey AS group_id, max(o_orderkey) AS commit_index FROM k JOIN orders ON o_custkey % 5 = n_regionkey WHERE o_orderkey % 2 = 1 AND o_orderkey <= l[len(l) // 2 + 1] GROUP BY 1""")
def quorum_commit_index(spark, d):
    name = lambda c: F.concat(F.lit("g"), c.cast("string")).alias("group_id")
    per = b.table(spark, d, "nation").join(b.table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    per = per.groupBy(name(F.col("n_regionkey")), "n_nationkey").agg((F.count("s_suppkey") * 100).alias("match_index"))
    members = per.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"))
    terms = b.table(spark, d, "orders").select(name(F.col("o_custkey") % 5), F.col("o_orderkey").alias("raft_index"), (F.col("o_orderkey") % 2).alias("raft_term"))
    return log.quorum_commit(per.join(members, "group_id"), ["group_id"], F.col("members"), terms, F.lit(1))


@query(f"WITH {_S} SELECT vshard, min_offset AS first_index, coalesce(lead(min_offset) OVER (PARTITION BY vshard ORDER BY min_offset) - 1, -1) AS last_index FROM seg QUALIFY last_index = -1 OR last_index > 99")
def file_range_inference(spark, d):
    files = b.segments(spark, d).select(*SHARD, F.col("min_offset").alias("first_index"))
    ranges = log.live_files(log.file_ranges(files, SHARD), 99)
    return ranges.select("vshard", "first_index", F.coalesce("last_index", F.lit(-1).cast("long")).alias("last_index"))


@query("SELECT event_id, CASE WHEN props IS NULL THEN 'correlation-id' ELSE 'props,correlation-id' END AS header_keys FROM events")
def header_default(spark, d):
    rows = b.unnumbered(spark, d)
    headers = scalars.default_header(F.col("headers"), scalars.CORRELATION, F.encode(F.col("event_id").cast("string"), "UTF-8"))
    twice = scalars.default_header(headers, scalars.CORRELATION, F.encode(F.lit("other"), "UTF-8"))
    return rows.select("event_id", F.concat_ws(",", F.transform(twice, lambda h: F.decode(h["key"], "UTF-8"))).alias("header_keys"))


@query(f"WITH {_M} SELECT vshard, off AS \"offset\", key, event_type AS payload, props, epoch_us(ts) AS micros FROM m")
def client_projection(spark, d):
    m = b.messages(spark, d)
    return m.select("vshard", "offset", F.decode("partition_key", "UTF-8").alias("key"), F.decode("payload", "UTF-8").alias("payload"), F.decode(scalars.header_map(F.col("headers"))["props"], "UTF-8").alias("props"), F.unix_micros("ts").alias("micros"))


@query(f"WITH {_S} SELECT vshard, printf('segment-%020d.sst', min_offset) AS name, min_offset AS parsed FROM seg")
def segment_names(spark, d):
    named = b.segments(spark, d).withColumn("name", scalars.segment_name(F.col("min_offset")))
    return named.select("vshard", "name", scalars.number_in_name(F.col("name")).alias("parsed"))


@query("""SELECT s_suppkey, greatest(0, CAST(s_acctbal AS BIGINT) - s_suppkey * 10) AS lag FROM supplier WHERE s_suppkey % 4 <> 0""")
def replication_lag(spark, d):
    s = b.table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 4 == 0).alias("is_leader"), F.rint("s_acctbal").cast("long").alias("leader_commit"), (F.col("s_suppkey") * 10).alias("commit_index"))
    return metrics.replication_lag(s).select("s_suppkey", "lag")


@query("SELECT bool_or(s_suppkey % 4 = 0) AND min(CAST(s_acctbal * 100 AS BIGINT)) >= -200000 AS ready, NOT bool_or(s_suppkey % 1000 = 999) AS alive FROM supplier")
def health(spark, d):
    k = F.col("s_suppkey")
    s = b.table(spark, d, "supplier").select((k % 4 == 0).alias("is_leader"), F.lit(False).alias("has_contact"), (k % 1000 == 999).alias("is_stuck"), F.rint(F.col("s_acctbal") * 100).cast("long").alias("free_bytes"))
    return metrics.health(s, -200_000)


@query("SELECT DISTINCT CAST(n_nationkey AS VARCHAR) AS node_id FROM nation WHERE n_nationkey <> 3")
def distinct_peers(spark, d):
    groups, _ = b.nodes(spark, d)
    members = groups.select(F.explode(F.transform("members", lambda m: m["node_id"])).alias("node_id"))
    return policy.peers(members.union(members), "3")


@query()
def codec_roundtrip(spark, d):
    w = _wal(spark, d)
    raw = w.withColumn("offset", F.col("raft_index")).withColumn("raw", codec.wal_bytes("record_type", "raft_term", "raft_index", "offset", F.unix_micros("ts"), "partition_key", "headers", "payload"))
    back = raw.select("raft_index", codec.wal_record("raw").alias("r"), "partition_key", "payload", hashing.crc32c_of("payload").alias("crc"))
    return back.select("raft_index", F.col("r.status").alias("status"), F.col("r.record_type").alias("record_type"), (F.col("r.payload").eqNullSafe(F.col("payload")) & F.col("r.partition_key").eqNullSafe(F.col("partition_key"))).alias("same"), "crc")
