"""One document of each near-duplicate group stays, by wide SimHash fingerprints.

Fingerprints of ``BITS`` bits over five-word shingles estimate the similarity
of two shingle sets from their Hamming distance.  At similarity 0.8 a sixth of
the bits differ, too many for block agreement, so shards are dealt by the least
value of each of ``MINIMA`` hash orders over the shingles: two documents of
similarity 0.8 share none of six with chance 0.2 ** 6.  Each shard holds its
fingerprints in a BK-tree, which finds the candidates within a radius that all
but one in 30,000 pairs of that similarity keep to.  Exact similarities of the
shingle sets then decide, so nothing goes that is less similar.

A shard over ``SHARD_ROWS`` members is dealt again: into pairs of tiles, without
loss, up to ``MOST_TILES`` tiles, and beyond that by ``SECOND`` further hash
orders, of which similar documents share none with chance 0.2 ** 8, and then
into pairs of tiles.  A pair is looked at in one cell only: that of the first
minima that it shares.

Texts are shuffled only where that matters: a Bloom filter of bounded size lets
rows pass that are in no group and leaves the others to exact joins.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import ensure_importable, hidden, materialize
from .components import connected_components
from .simhash import BKTree

BITS, MINIMA, SECOND, SHINGLE, SHARD_ROWS, MOST_TILES = 512, 6, 8, 5, 1024, 8
SIMILARITY = 0.8
#: Words of 64 bits of a Bloom filter, and bits that a name sets in its word.
WORDS, MARKS = 1 << 16, 2
#: Standard deviations of a distance that candidates may lie beyond its mean.
ALLOWANCE = 4.0


def radius(similarity: float = SIMILARITY, bits: int = BITS) -> int:
    """Bits within which sets of that Jaccard similarity lie, with ``ALLOWANCE``."""
    cosine = 2 * similarity / (1 + similarity)
    p = math.acos(cosine) / math.pi
    return round(bits * p + ALLOWANCE * math.sqrt(bits * p * (1 - p)))


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of 64-bit mixings of a hash."""
    with np.errstate(over="ignore"):
        x = h + np.uint64((k * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct word shingles, ascending; of all words together where they are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.array([], dtype=np.uint64)
    grams = {b" ".join(words)} if len(words) < shingle else set(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 7) for g in grams), dtype=np.uint64, count=len(grams)))


def sketch(h: np.ndarray) -> tuple[bytes, list[int]]:
    """Fingerprint bytes and the minima of each hash order of shingle hashes; zeros for a text without words."""
    if not len(h):
        return bytes(BITS // 8), [0] * (MINIMA + SECOND)
    out = []
    for k in range(BITS // 64):
        m = _mix(h, k)
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(m), 1 << 14):
            ones += np.unpackbits(m[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(h), bitorder="little").tobytes())
    return b"".join(out), [int(_mix(h, 100 + k).min().view(np.int64)) for k in range(MINIMA + SECOND)]


#: A member of a cell has those of its minima that come before the cell's.
#: A cell: place and value of the shared minimum, of the second one (-1 and 0 without), and the pair of tiles.
CELL = {"k": "int", "v": "long", "j": "int", "w": "long", "t": "int", "o": "int"}
_MEMBER = {"mine": "int", "name": "string", "fp": "binary", "mins": "array<long>"}


def _kind(columns: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for c, t in columns.items())


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The members of one cell after another, from rows sorted by cell."""
    key, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[: len(CELL)] != key:
                if held:
                    yield key, held
                key, held = row[: len(CELL)], []
            held.append(row[len(CELL) :])
    if held:
        yield key, held


def _pairs(key: tuple, members: list[tuple], limit: int) -> Iterator[tuple[int, int]]:
    """Places of each two members within ``limit`` bits that no earlier cell looks at."""
    *_, t, o = key
    tree, places = BKTree(), []
    for at, (mine, _, fp, mins, *_) in enumerate(members):
        value, size = int.from_bytes(fp, "little"), len(tree.values)
        for i in tree.within(value, limit):
            b = places[i]
            theirs = members[b]
            if t != o and mine == theirs[0]:
                continue  # the cell of that tile alone has them
            if any(x == y for x, y in zip(mins, theirs[3], strict=True)):
                continue
            yield b, at
        tree.insert(value)
        if len(tree.values) > size:
            places.append(at)


def _candidates(limit: int):
    """Cell and name of each member with a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, members in _cells(batches):
            found = sorted({x for pair in _pairs(key, members, limit) for x in pair}) if len(members) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([*(pa.array([v] * len(found), pa.int64() if c in "vw" else pa.int32()) for c, v in zip(CELL, key, strict=True)), *(pa.array([members[i][f] for i in found], kind) for f, kind in ((0, pa.int32()), (1, pa.string()), (2, pa.binary()), (3, pa.list_(pa.int64()))))], [*CELL, *_MEMBER])

    return run


def _confirmed(limit: int, similarity: float):
    """Links of members whose exact similarity is ``similarity`` or more: a spanning forest of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, members in _cells(batches):
            sets = [np.frombuffer(m[4], dtype="<u8") for m in members]
            parent = list(range(len(members)))
            links = []

            def root(i: int, parent: list[int] = parent) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for a, b in _pairs(key, members, limit):
                if root(a) == root(b):
                    continue
                x, y = sets[a], sets[b]
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both):
                    parent[root(a)] = root(b)
                    links.append((members[a][1], members[b][1]))
            if links:
                yield pa.RecordBatch.from_pydict({"u": pa.array([u for u, _ in links], pa.string()), "v": pa.array([v for _, v in links], pa.string())})

    return run


def _shards(distinct: DataFrame, shard_rows: int, most_tiles: int) -> DataFrame:
    """The cells and their members."""
    member = list(_MEMBER)
    sized = lambda df, keys: materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows).select(*keys, F.ceil(F.col("n") / shard_rows).cast("int").alias("tiles")), "nd-large")
    earlier = F.concat(F.slice("mins", F.lit(1), F.col("k")), F.slice("mins", F.lit(MINIMA + 1), F.greatest(F.col("j") - MINIMA, F.lit(0))))
    placed = lambda df: df.withColumn("mins", earlier).select(*CELL, *member)
    flat = lambda df: placed(df.withColumns({"t": F.lit(0), "o": F.lit(0), "mine": F.lit(0)}))

    def tiled(df: DataFrame) -> DataFrame:
        mine = F.pmod(F.xxhash64("name"), F.col("tiles")).cast("int")
        spread = df.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        return placed(spread.withColumns({"t": F.least("mine", "other"), "o": F.greatest("mine", "other")}))

    one, two = ["k", "v"], ["k", "v", "j", "w"]
    first = distinct.select("name", "fp", "mins", F.posexplode(F.slice("mins", 1, MINIMA)).alias("k", "v")).withColumns({"j": F.lit(-1), "w": F.lit(0).cast("long")})
    large = sized(first, one)
    out = flat(first.join(large, one, "left_anti"))
    if large.isEmpty():
        return out
    out = out.union(tiled(first.join(large.where(F.col("tiles") <= most_tiles), one)))
    again = first.join(large.where(F.col("tiles") > most_tiles), one, "left_semi").drop("j", "w")
    dealt = F.posexplode(F.slice("mins", MINIMA + 1, SECOND)).alias("j", "w")
    second = materialize(again.select("*", dealt).withColumn("j", F.col("j") + MINIMA), "nd-second")
    crowd = sized(second, two)
    return out.union(flat(second.join(crowd, two, "left_anti"))).union(tiled(second.join(crowd, two)))


def add_sketches(docs: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """``docs`` with ``<prefix>name`` (of the fingerprint), ``<prefix>fp`` and ``<prefix>mins``."""
    ensure_importable(docs.sparkSession)
    at, names = docs.columns.index(text_col), [prefix + c for c in ("name", "fp", "mins")]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.BinaryType(), T.ArrayType(T.LongType())), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sketch(shingles(None if (x := t.as_py()) is None else str(x))) for t in b.column(at)]
            new = [pa.array([hashlib.md5(f).hexdigest() for f, _ in found], pa.string()), pa.array([f for f, _ in found], pa.binary()), pa.array([m for _, m in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def _with_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t.as_py()).astype("<u8").tobytes() for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["name", "grams"])


def _mark(key: list[Column]) -> tuple[Column, Column]:
    """The word of a key in a Bloom filter, and the bits that it sets there."""
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(*key, F.lit(k)), F.lit(64)).cast("int"))
    bits = one(1)
    for k in range(2, MARKS + 1):
        bits = bits.bitwiseOR(one(k))
    return F.pmod(F.xxhash64(*key, F.lit(0)), F.lit(WORDS)).cast("int"), bits


def bloom(keys: DataFrame, label: str) -> DataFrame:
    """A Bloom filter ``(word, bits)`` of the rows of ``keys``, of ``WORDS`` rows at most however many there are."""
    word, bits = _mark([F.col(c) for c in keys.columns])
    return materialize(keys.select(word.alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")), label)


def sifted(rows: DataFrame, key: list[str], marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be in a Bloom filter, with all that are, and those whose key is not; no row is shuffled."""
    word, bits = _mark([F.col(c) for c in key])
    h = hidden(rows.columns)
    marks = marked.select(F.col("word").alias(f"{h}word"), F.col("bits").alias(f"{h}bits"))
    held = rows.join(F.broadcast(marks), word == F.col(f"{h}word"), "left")
    found = F.coalesce(F.col(f"{h}bits").bitwiseAND(bits) == bits, F.lit(False))
    return held.where(found).select(*rows.columns), held.where(~found).select(*rows.columns)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shard_rows: int = SHARD_ROWS, most_tiles: int = MOST_TILES) -> DataFrame:
    """``docs`` without all but one row of each group of near duplicates.

    The row with the smallest id stays (a null id is larger than any; of rows
    with one id, that with the smallest fingerprint name, of equal ones any).
    Texts without words are duplicates of each other; a null text has no words.
    Texts of any length are taken whole.  Rows with equal fingerprints are
    duplicates; others link if the exact Jaccard similarity of their shingles is
    ``similarity`` or more, and groups are what such links connect.  Columns stay
    as they are, whatever their names; an empty table gives an empty table.
    """
    slots = [f"c{i}" for i in range(len(docs.columns))]
    ident, text = (F.col(slots[docs.columns.index(c)]) for c in (id_col, text_col))
    rows = materialize(add_sketches(docs.toDF(*slots), slots[docs.columns.index(text_col)], "__"), "nd-rows")
    distinct = materialize(rows.groupBy(F.col("__name").alias("name")).agg(F.first("__fp").alias("fp"), F.first("__mins").alias("mins")), "nd-distinct")
    limit, member = radius(similarity), [*CELL, *_MEMBER]
    dealt = _shards(distinct, shard_rows, most_tiles).repartition(*CELL).sortWithinPartitions(*CELL, "fp")
    asked = materialize(dealt.mapInArrow(_candidates(limit), _kind(CELL | _MEMBER)), "nd-asked")
    names = materialize(asked.select("name").distinct(), "nd-names")
    texts, _ = sifted(rows.select(F.col("__name").alias("name"), text.cast("string").alias("text")), ["name"], bloom(names, "nd-asked-bits"))
    texts = texts.join(names, "name", "left_semi")
    grams = materialize(texts.mapInArrow(_with_shingles, "name string, grams binary"), "nd-grams").groupBy("name").agg(F.first("grams").alias("grams"))
    ready = asked.join(grams, "name").select(*member, "grams").repartition(*CELL).sortWithinPartitions(*CELL, "fp")
    roots = connected_components(ready.mapInArrow(_confirmed(limit, similarity), "u string, v string"))
    owners = materialize(rows.groupBy(F.col("__name").alias("name"), ident.alias("id")).agg(F.count(F.lit(1)).alias("n")), "nd-owners")
    roots = materialize(roots.select(F.col("node").alias("name"), "root"), "nd-roots")
    shared = owners.groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select("name")
    contested = bloom(roots.select("name").union(shared), "nd-contested")
    owned = sifted(owners, ["name"], contested)[0].join(roots, "name", "left")
    best = owned.groupBy(F.coalesce("root", "name").alias("root")).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "name", "n")).alias("b"))
    best = materialize(best.select(F.col("b.id").alias("__keep"), F.col("b.name").alias("__of"), F.col("b.n").alias("__n")), "nd-kept")
    unsure, alone = sifted(rows, ["__name"], contested)
    unsure, _ = sifted(unsure, ["__name", slots[docs.columns.index(id_col)]], bloom(best.select("__of", "__keep"), "nd-kept-bits"))
    kept = unsure.join(best, (F.col("__name") == F.col("__of")) & ident.eqNullSafe(F.col("__keep")))
    columns = [F.col(s).alias(c) for s, c in zip(slots, docs.columns, strict=True)]
    single = kept.where(F.col("__n") == 1).select(*columns)
    again = kept.where(F.col("__n") > 1).withColumn("__r", F.row_number().over(Window.partitionBy("__of", "__keep").orderBy(F.xxhash64(text)))).where(F.col("__r") == 1)
    return alone.select(*columns).union(single).union(again.select(*columns))
