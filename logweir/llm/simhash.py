"""SimHash fingerprints and near-duplicate groups found with BK-trees.

Fingerprints within radius ``r`` differ in at most ``r`` bits, so of ``r + 1``
disjoint bit blocks at least one agrees.  Distinct fingerprints are dealt to one
shard per block value; each shard builds a BK-tree (children keyed by their
integer Hamming distance to the parent) and looks up every member, following
only the edges within the radius.  A shard over ``SHARD_ROWS`` members is dealt
again by blocks of its remaining bits, which by the same argument loses no
pair, until it fits or no bits are left to split.  Trees travel to their shard
with the shuffle and not as a broadcast: together they grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import ensure_importable, materialize
from .components import connected_components

SEED = 42
SHARD_ROWS = 1024
LEVELS = 4
ALL = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of word shingles, repeats included; 0 without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, six ASCII spaces only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(h)).tolist()))


def add_fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = 3) -> DataFrame:
    """``keep`` columns and ``fp`` (signed 64-bit) of each row; null text counts as empty."""
    ensure_importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([signed(fingerprint(t.as_py(), shingle)) for t in b.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], fps], [*names, "fp"])

    names = [f"k{i}" for i in range(len(keep))]
    source = docs.select(F.col(text).cast("string").alias("t"), *(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)))
    schema = ", ".join([*(f"{n} {source.schema[n].dataType.simpleString()}" for n in names), "fp long"])
    out = source.mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "fp")


class BKTree:
    """Metric tree of integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, value: int) -> None:
        values, children, new = self.values, self.children, len(self.values)
        if new:
            at = 0
            while True:
                d = (values[at] ^ value).bit_count()
                if d == 0:
                    return
                if d not in children[at]:
                    children[at][d] = new
                    break
                at = children[at][d]
        values.append(value)
        children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """Places of the held values at distance ``radius`` or less."""
        found, stack, values, children = [], [0] if self.values else [], self.values, self.children
        while stack:
            at = stack.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for edge, child in children[at].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        return found


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links of ``values`` within ``radius``, reduced to a spanning forest."""
    tree, links = BKTree(), []
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for v in values:
        near, size = tree.within(v, radius), len(tree.values)
        tree.insert(v)
        if len(tree.values) == size:
            continue
        parent.append(size)
        for i in near:
            a, b = root(size), root(i)
            if a != b:
                parent[a] = b
                links.append((v, tree.values[i]))
    return links


def _parts(bits: list[int], n: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(bits, n) if len(x)]


def masks(levels: int, radius: int) -> list[dict[int, list[int]]]:
    """Per level: mask -> the wider masks its shards are dealt to."""
    out, level = [], [0]
    for _ in range(levels):
        step = {m: [m | sum(1 << int(i) for i in p) for p in _parts([i for i in range(64) if not m >> i & 1], radius + 1)] for m in level}
        out.append(step)
        level = sorted({x for v in step.values() for x in v})
    return out


def _shard_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> pa.RecordBatch | None:
            links = forest([x & ALL for x in held], radius) if len(held) > 1 else []
            if links:
                return pa.RecordBatch.from_pydict({"u": pa.array([signed(a) for a, _ in links], pa.int64()), "v": pa.array([signed(b) for _, b in links], pa.int64())})
            return None

        for b in batches:
            for mask, value, fp in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (mask, value) != key:
                    if (out := flush()) is not None:
                        yield out
                    key, held = (mask, value), []
                held.append(fp)
        if (out := flush()) is not None:
            yield out

    return run


def fingerprint_links(distinct: DataFrame, radius: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links ``(u, v)`` that connect all values of ``distinct.fp`` within ``radius`` bits.

    Links are a spanning forest of each shard, not all pairs, so their number
    stays in proportion to the fingerprints.
    """
    ensure_importable(distinct.sparkSession)
    members, small = distinct.select(F.lit(0).cast("long").alias("mask"), "fp"), []
    steps = masks(LEVELS, radius)
    for level, step in enumerate(steps):
        deal = F.create_map(*(x for m, v in step.items() for x in (F.lit(signed(m)), F.array(*(F.lit(signed(c)) for c in v)))))
        members = members.select(F.explode(deal[F.col("mask")]).alias("mask"), "fp").withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        if level == len(steps) - 1:
            small.append(members)
            break
        large = members.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows)
        large = materialize(large.select("mask", "value"), "bk-large")
        if large.isEmpty():
            small.append(members)
            break
        small.append(members.join(large, ["mask", "value"], "left_anti"))
        members = materialize(members.join(large, ["mask", "value"], "left_semi").select("mask", "fp"), "bk-dealt")
    found = None
    for m in small:
        rows = m.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
        links = rows.mapInArrow(_shard_links(radius), "u long, v long")
        found = links if found is None else found.union(links)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row of ``docs``.

    Rows whose fingerprints differ in ``radius`` bits or less are linked;
    ``component_id`` is the smallest id reachable.  Null or wordless texts have
    fingerprint zero and are linked like any other.  A null id is never the
    smallest; a component of null ids only has a null ``component_id``.
    Repeated rows each come back.  An empty table gives an empty result, and
    other columns of ``docs`` are not read.
    """
    rows = materialize(add_fingerprints(docs, text_col, (id_col,), shingle).withColumnRenamed(id_col, "doc"), "simhash")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc").alias("first_doc")), "simhash-distinct")
    roots = connected_components(fingerprint_links(distinct, radius, shard_rows))
    linked = distinct.join(roots, distinct.fp == roots.node).select("fp", "root", "first_doc")
    linked = materialize(linked, "simhash-linked")
    # written, so that the join below deals both sides alike and can split a large component
    least = materialize(linked.groupBy("root").agg(F.min("first_doc").alias("least")), "simhash-least")
    of_linked = linked.select("fp", "root").join(least, "root").select("fp", "least")
    names = materialize(distinct.join(of_linked, "fp", "left").select("fp", F.coalesce("least", "first_doc").alias("component_id")), "simhash-names")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(names, "fp").select(F.col("doc").alias(id_col), digits.alias("fingerprint"), "component_id")
