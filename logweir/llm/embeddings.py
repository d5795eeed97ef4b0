"""Near-duplicate embeddings by product quantisation.

Coarse centroids split the vectors of a label into inverted lists; the residual
of each vector is coded per subspace.  A vector searches every list that could
hold a partner: one on the far side of the bisector between two centroids is at
least that far away, so the lists whose bisector is nearer than the radius
suffice.  Both ends of a link pass that bound, so of two lists only one sends
its vectors to the other, and each pair is looked at once.  In a list, asymmetric
table-lookup distances discard what the code's own error cannot explain, and exact
double-precision cosines decide the rest.  Both bounds are exact, so no link is
lost; the codebooks only set the speed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import ensure_importable, materialize
from .components import connected_components

COSINE = 0.98
#: Vectors that codebooks are fitted on; subspaces; codes to a subspace; most coarse lists.
SAMPLE, SUBSPACES, CODES, MOST_LISTS = 16_384, 8, 64, 1024
#: Most vectors of a list in one tile; longer lists are dealt to several tiles.
TILE, QUERY_TILE = 2048, 16_384
_EPS = 1e-9


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(0)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Index:
    """Coarse centroids and residual codebooks for unit vectors of one length."""

    def __init__(self, x: np.ndarray, lists: int):
        self.coarse = _kmeans(x, lists)
        r = x - self.coarse[self.nearest(x)]
        self.parts = [p for p in np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))]
        self.books = [_kmeans(r[:, p], CODES) for p in self.parts]

    def squares(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x * x).sum(1)[:, None] + (self.coarse**2).sum(1) - 2 * x @ self.coarse.T, 0)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return self.squares(x).argmin(1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the distance between each vector and what its code stands for."""
        r = x - self.coarse[lists]
        codes, back = np.empty((len(x), len(self.parts)), dtype=np.uint8), np.empty_like(r)
        for m, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            codes[:, m] = ((b * b).sum(1) - 2 * r[:, p] @ b.T).argmin(1)
            back[:, p] = b[codes[:, m]]
        return codes, np.sqrt(((r - back) ** 2).sum(1))

    def probes(self, x: np.ndarray, own: np.ndarray, radius: float) -> np.ndarray:
        """Which lists each vector is sent to: those that may hold one within ``radius``.

        Of two lists the one that comes at most half way round after the other
        receives, so that no list sends to all; a vector is sent to its own too.
        """
        d = self.squares(x)
        gap = d - d[np.arange(len(x)), own][:, None]
        between = np.sqrt(np.maximum(((self.coarse[own][:, None] - self.coarse[None]) ** 2).sum(2), 1e-30))
        k = len(self.coarse)
        turn = (np.arange(k)[None] - own[:, None]) % k
        receives = (2 * turn < k) | ((2 * turn == k) & (own < k // 2)[:, None])
        out = receives & (gap / (2 * between) <= radius + _EPS)
        out[np.arange(len(x)), own] = True
        return out

    def estimates(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Table-lookup distances from whole queries to coded vectors of list ``at``."""
        r = q - self.coarse[at]
        total = np.zeros((len(q), len(codes)))
        for m, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            table = (r[:, p] ** 2).sum(1)[:, None] + (b * b).sum(1) - 2 * r[:, p] @ b.T
            total += table[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0))


def _units(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.empty((len(raw), dim))
    for width in (4, 8):
        at = [i for i, r in enumerate(raw) if len(r) == width * dim]
        if at:
            x[at] = np.frombuffer(b"".join([raw[i] for i in at]), dtype=f"<f{width}").reshape(len(at), dim)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _valid(embedding: np.ndarray | None) -> bytes | None:
    """A vector's components; None unless they are all finite and not all zero.

    Vectors are scaled by a power of two first, so squares stay finite and digits
    stay as they are.  Components are floats where that loses nothing, else doubles.
    """
    if embedding is None:
        return None
    x = np.array([np.nan if v is None else v for v in embedding], dtype="<f8") if embedding.dtype == object else np.asarray(embedding, dtype="<f8")
    if not len(x) or not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = np.ldexp(x, -np.frexp(top)[1])
    short = x.astype("<f4")
    return (short if (short == x).all() else x).tobytes()


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for b in batches:
        raw, dims = [], []
        for label, e in zip(b.column(1).to_pylist(), b.column(2), strict=True):
            raw.append(None if label is None or not e.is_valid else _valid(np.array(e.values.to_numpy(zero_copy_only=False))))
            dims.append(None if raw[-1] is None else len(e.values))
        names = [None if r is None else hashlib.sha256(f"{d}:{k}:".encode() + r).hexdigest()[:32] for k, d, r in zip(b.column(1).to_pylist(), dims, raw, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["id", "label", "class", "dim", "raw"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, lists: int | None = None, tile: int = TILE, query_tile: int = QUERY_TILE) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for each row of ``vectors``.

    Rows link if their labels are equal and the cosine of their vectors is
    ``cosine`` or more.  Null, empty, zero and non-finite vectors, vectors with
    a null component and rows without a label link with nothing, and vectors of
    different lengths never link.  Equal vectors form a class that is compared
    once; links count all its rows.  Repeated rows are rows of their own; a null
    id is never the smallest.  An unlinked row is its own component.
    """
    spark = vectors.sparkSession
    ensure_importable(spark)
    radius = math.sqrt(2 - 2 * cosine) + _EPS
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("e"))
    rows = materialize(source.mapInArrow(_classes, "id long, label string, class string, dim int, raw binary"), "pq-rows")
    classes = rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("raw").alias("raw"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"))
    classes = materialize(classes, "pq-classes")

    indexes: dict[int, Index] = {}
    for d in sorted(r["dim"] for r in classes.select("dim").distinct().collect()):
        own = classes.where(F.col("dim") == d)
        n = own.count()
        sample = own.orderBy("class").limit(SAMPLE).select("raw").collect()  # hashes as names: a random sample
        indexes[d] = Index(_units([bytes(r["raw"]) for r in sample], d), lists or int(min(MOST_LISTS, max(1, round(math.sqrt(n) / 2)))))
    held = spark.sparkContext.broadcast(indexes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            frame = b.to_pandas()
            for d, f in frame.groupby("dim"):
                index = held.value[d]
                for at in range(0, len(f), 512):
                    part = f.iloc[at : at + 512]
                    x = _units(list(part["raw"]), int(d))
                    own = index.nearest(x)
                    codes, err = index.encode(x, own)
                    probes = [np.flatnonzero(p).tolist() for p in index.probes(x, own, radius)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part["class"]), pa.array(part["label"]), pa.array(part["dim"], pa.int32()), pa.array(part["raw"], pa.binary()), pa.array(part["copies"], pa.int64()), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err, pa.float64()), pa.array(probes, pa.list_(pa.int32()))],
                        ["class", "label", "dim", "raw", "copies", "list", "code", "err", "probes"],
                    )

    placed = classes.select("class", "label", "dim", "raw", "copies").mapInArrow(place, "class string, label string, dim int, raw binary, copies long, list int, code binary, err double, probes array<int>")
    placed = materialize(placed, "pq-placed")
    key = ["label", "dim", "list"]
    asked = placed.select("class", "label", "dim", "raw", "copies", F.col("list").alias("own"), F.explode("probes").alias("list"))
    counts = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(asked.groupBy(*key).agg(F.count(F.lit(1)).alias("nq")), key)
    counts = counts.select(*key, F.ceil(F.col("n") / tile).cast("int").alias("tiles"), F.ceil(F.col("nq") / query_tile).cast("int").alias("slices"))
    counts = materialize(counts, "pq-lists")
    part = lambda n: F.pmod(F.xxhash64("class"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    data = placed.join(counts, key).select(*key, part(F.col("tiles")).alias("tile"), every(F.col("slices")).alias("slice"), F.lit(0).alias("query"), "class", "raw", "copies", "code", "err")
    asks = asked.join(counts, key).select(*key, every(F.col("tiles")).alias("tile"), part(F.col("slices")).alias("slice"), F.when(F.col("list") == F.col("own"), 2).otherwise(1).alias("query"), "class", "raw", "copies", F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("err"))
    cell = [*key, "tile", "slice"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        base: list[pd.DataFrame] = []
        ready: tuple | None = None
        parent: dict[str, str] = {}

        def root(c: str) -> str:
            while parent.setdefault(c, c) != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        def prepare() -> tuple:
            f = pd.concat(base)
            codes = np.frombuffer(b"".join(f["code"]), dtype=np.uint8).reshape(len(f), -1)
            return _units(list(f["raw"]), int(current[1])), codes, f["err"].to_numpy(), f["class"].to_numpy(), f["copies"].to_numpy()

        for b in batches:
            frame = b.to_pandas()
            step = (frame[cell] != frame[cell].shift()).any(axis=1).cumsum()
            for _, f in frame.groupby(step, sort=False):
                k = tuple(f.iloc[0][cell])
                if k != current:
                    current, base, ready, parent = k, [], None, {}
                if len(d := f[f["query"] == 0]):
                    base.append(d)
                asks_ = f[f["query"] > 0]
                if not len(asks_) or not base:
                    continue
                ready = ready or prepare()
                y, codes, err, names, copies = ready
                index = held.value[int(k[1])]
                for at in range(0, len(asks_), 256):
                    q = asks_.iloc[at : at + 256]
                    x, mine, mine_copies = _units(list(q["raw"]), int(k[1])), q["class"].to_numpy(), q["copies"].to_numpy()
                    i, j = np.nonzero(index.estimates(x, int(k[2]), codes) <= radius + err + 1e-6)
                    once = (q["query"].to_numpy() == 1)[i] | (mine[i] < names[j])
                    i, j = i[once], j[once]
                    links, back, pairs = np.zeros(len(q), dtype=np.int64), np.zeros(len(names), dtype=np.int64), []
                    for s in range(0, len(i), 1 << 16):
                        a, c = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                        near = np.einsum("nd,nd->n", x[a], y[c]) >= cosine
                        np.add.at(links, a[near], copies[c[near]])
                        np.add.at(back, c[near], mine_copies[a[near]])
                        pairs += zip(mine[a[near]], names[c[near]], strict=True)
                    found = []
                    for u, v in pairs:
                        ru, rv = root(u), root(v)
                        if ru != rv:
                            parent[max(ru, rv)] = min(ru, rv)
                            found.append((u, v))
                    hit, met = np.flatnonzero(links), np.flatnonzero(back)
                    us = [*mine[hit], *names[met], *(u for u, _ in found)]
                    if us:
                        vs, n_links = [None] * (len(hit) + len(met)) + [v for _, v in found], [*links[hit].tolist(), *back[met].tolist(), *([0] * len(found))]
                        yield pa.RecordBatch.from_arrays([pa.array(us, pa.string()), pa.array(vs, pa.string()), pa.array(n_links, pa.int64())], ["u", "v", "links"])

    dealt = data.union(asks).repartition(*cell).sortWithinPartitions(*cell, "query", "class")
    found = materialize(dealt.mapInArrow(search, "u string, v string, links long"), "pq-found")
    links = found.where(F.col("v").isNull()).groupBy(F.col("u").alias("class")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where(F.col("v").isNotNull()).select("u", "v"))
    named = classes.select("class", "copies", "first_id").join(roots, F.col("class") == F.col("node"), "left").join(links, "class", "left")
    named = materialize(named.select("class", "copies", "first_id", F.coalesce("root", "class").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "pq-named")
    # written, so that the join below deals both sides alike and can split a large component
    least = materialize(named.groupBy("root").agg(F.min("first_id").alias("component")), "pq-least")
    by_class = materialize(named.join(least, "root").select("class", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component"), "pq-members")
    out = rows.select("id", "class").join(by_class, "class", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
