"""Byte-level BPE by overlapping chunks.

Every text is cut into overlapping chunks that are pre-tokenised on their own (a
short text is one chunk).  The pattern looks at nothing before a match, so once
two chunks share a pre-token boundary they agree from there on; chunks are
stitched at such boundaries, and a stretch without one is pre-tokenised again
from the last sure boundary.  The stitched pieces are then encoded by rank merges
and decoded by concatenating each id's raw bytes.  Chunks of texts over ``SPREAD``
characters are pre-tokenised by many tasks, those of others where the text is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import ensure_importable, materialize, quoted

#: Characters of a chunk, by which chunks overlap, and beyond which a text's chunks are dealt to other tasks.
CHUNK, OVERLAP, SPREAD = 4096, 256, 65_536


class Codec:
    """Ranks and pattern of a byte-level BPE; remembers the ids of pieces."""

    MEMO = 400_000

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.names = {i: str(i) for i in self.tokens}
        self.memo: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece: join the pair of least rank, the leftmost first, until none is left."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        if len(piece) > 256:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
        while True:
            best, at = None, -1
            for i, r in enumerate(pairs):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return tuple(ranks[p] for p in parts)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges with a heap and linked places, for very long pieces."""
        from heapq import heapify, heappop, heappush

        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # end of the part that starts here; 0 once merged away
        before = list(range(-1, n - 1))

        def pair(i: int) -> int | None:
            j = end[i]
            return ranks.get(piece[i : end[j]]) if j < n else None

        heap = [(r, i, i + 2) for i in range(n - 1) if (r := pair(i)) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two has changed meanwhile
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
            for k in (i, before[i]):
                if k >= 0 and (r := pair(k)) is not None:
                    heappush(heap, (r, k, end[end[k]]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, pieces: list[str]) -> list[int]:
        memo = self.memo
        try:
            return list(chain.from_iterable([memo[p] for p in pieces]))
        except KeyError:
            pass
        if len(memo) > self.MEMO:
            memo.clear()
        out: list[int] = []
        for p in pieces:
            ids = memo.get(p)
            if ids is None:
                ids = self.merge(p.encode())
                if len(p) <= 64:
                    memo[p] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def sure(self, chunk: str, last: bool) -> list[str]:
        """The chunk's pieces; one that touches a cut is not sure and left out."""
        out = self.pattern.findall(chunk)
        if not last and out:
            out.pop()
        return out


def cut(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, str, bool]]:
    """Start, text and whether it is the last of each chunk."""
    starts = range(0, max(len(text) - overlap, 1), chunk - overlap)
    return [(s, text[s : s + chunk], s == starts[-1]) for s in starts]


def stitch(text: str, chunks: Iterable[tuple[int, list[str]]], codec: Codec) -> tuple[list[str], int]:
    """Pieces of ``text`` from each chunk's start and sure pieces, and how often no boundary was shared.

    Exact for patterns without look-behind that match at every place.
    """
    out: list[str] = []
    at = repaired = 0  # where the pieces so far end
    for start, pieces in chunks:
        end = start + sum(map(len, pieces))
        if start == 0:
            out, at = list(pieces), end
            continue
        known, i, p = {at: len(out)}, len(out), at
        while i and p > start:
            i -= 1
            p -= len(out[i])
            known[p] = i
        p, k = start, 0
        while p not in known and k < len(pieces) and p <= at:
            p += len(pieces[k])
            k += 1
        if p in known:
            out[known[p] :] = pieces[k:]
            at = max(end, p)
            continue
        repaired += 1
        places, p = {}, start
        for k, x in enumerate(pieces):
            p += len(x)
            places[p] = k + 1
        for m in codec.pattern.finditer(text, at):
            out.append(m[0])
            at = m.end()
            if at in places:
                out += pieces[places[at] :]
                at = end
                break
    if at < len(text):
        out += codec.pattern.findall(text, at)
    return out, repaired


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One to a worker process, kept between tasks."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def pieces_of(c: Codec, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    return stitch(text, ((start, c.sure(part, last)) for start, part, last in cut(text, chunk, overlap)), c)[0]


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", with_ids: bool = False, spread: int = SPREAD, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``keep`` and ``n_tokens, ids_sha256, decoded_sha256`` (and ``ids``) of each row.

    The digests are of the decimal ids joined by a space and of the bytes that
    decoding those ids gives.  Null texts count as empty: no ids, the digests of
    nothing.  Very long texts are encoded whole, repeated ones once.  Repeated rows
    each come back, an empty table gives no rows, other columns are not read and
    may have any name.
    """
    ensure_importable(docs.sparkSession)
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("t"), *(quoted(c).alias(n) for c, n in zip(keep, names, strict=True)))
    kinds = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in names]
    results = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    columns = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] * with_ids)]

    def finish(c: Codec, texts: Iterator[list[str]]) -> list[pa.Array]:
        out: list[tuple] = []
        for pieces in texts:
            ids, shown = c.encode(pieces), c.names
            listed = hashlib.sha256(" ".join([shown[i] for i in ids]).encode()).hexdigest()
            out.append((len(ids), listed, hashlib.sha256(c.decode(ids)).hexdigest(), *([np.array(ids, dtype=np.int32)] * with_ids)))
        types = [pa.int64(), pa.string(), pa.string(), *([pa.list_(pa.int32())] * with_ids)]
        return [pa.array([r[i] for r in out], k) for i, k in enumerate(types)]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], *finish(c, (pieces_of(c, t.as_py(), chunk, overlap) for t in b.column(0)))], [*names, *columns])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                parts = cut(t.as_py(), chunk, overlap)
                for at in range(0, len(parts), 256):
                    some = parts[at : at + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([h] * len(some), pa.string()), pa.array([p[0] for p in some], pa.int64()), pa.array([p[1] for p in some], pa.string()), pa.array([p[2] for p in some], pa.bool_())], ["h", "start", "part", "last"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            sizes = [np.array(list(map(len, c.sure(t.as_py(), last))), dtype="<i4").tobytes() for t, last in zip(b.column(2), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.binary())], ["h", "start", "sizes"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)

        def chunks(t: str, parts: list[dict]) -> Iterator[tuple[int, list[str]]]:
            for p in sorted(parts, key=lambda p: p["start"]):
                ends = p["start"] + np.cumsum(np.frombuffer(p["sizes"], dtype="<i4"))
                bounds = [p["start"], *ends.tolist()]
                yield p["start"], [t[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

        def texts(b: pa.RecordBatch) -> Iterator[list[str]]:
            for t, parts in zip(b.column(1), b.column(2), strict=True):
                text = t.as_py()
                yield stitch(text, chunks(text, parts.as_py()), c)[0]

        for big in batches:
            for at in range(0, big.num_rows, 64):
                b = big.slice(at, 64)
                yield pa.RecordBatch.from_arrays([b.column(0), *finish(c, texts(b))], ["h", *columns])

    near = rows.where(F.length("t") <= spread).mapInArrow(whole, ", ".join([*kinds, results]))
    large = materialize(rows.where(F.length("t") > spread).withColumn("h", F.sha2("t", 256)), "bpe-long")
    texts = large.select("h", "t").dropDuplicates(["h"])
    parts = texts.mapInArrow(deal, "h string, start long, part string, last boolean").repartition("h", "start")
    sizes = parts.mapInArrow(split, "h string, start long, sizes binary").groupBy("h").agg(F.collect_list(F.struct("start", "sizes")).alias("parts"))  # of one text only
    stitched = materialize(texts.join(sizes, "h").select("h", "t", "parts").mapInArrow(join, "h string, " + results), "bpe-stitched")
    done = large.drop("t").join(stitched, "h").select(*names, *columns)
    return near.union(done).select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), *columns)
