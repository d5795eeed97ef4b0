"""Token ids in shard files, each a wavelet matrix over the ids of many documents.

A shard file holds the succinct bit-planes of its ids (most significant bit
first, each plane stably split by the one before), rank directories, and the
table of its documents.  ``access``, ``rank`` (counting) and ``select``
(occurrence lookup) work on the planes; ``decode`` gives all ids.  Files are
written and read by Spark's own file sources, so they live in any store that
Spark reaches and a lost task leaves no half-written file behind.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import ensure_importable, shared_dir

MAGIC = b"LWWM0001"
BLOCK = 512  # bits to a rank block
#: Rows of a document range, and the most ranges; larger tables get longer ranges.
RANGE_ROWS, MOST_RANGES = 2048, 20_000
#: A file is closed at so many ids; a document is never split.
FILE_IDS = 2_000_000


class WaveletMatrix:
    """Wavelet matrix of unsigned integers below ``2 ** width``."""

    def __init__(self, n: int, width: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray] | None = None):
        self.n, self.width, self.planes, self.zeros = n, width, planes, zeros
        self.ranks = ranks if ranks is not None else [self._directory(p) for p in planes]

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        """Ones before each block of BLOCK bits."""
        step = BLOCK // 8
        padded = np.zeros(-(-max(len(plane), 1) // step) * step, dtype=np.uint8)
        padded[: len(plane)] = plane
        ones = np.bitwise_count(padded).reshape(-1, step).sum(axis=1, dtype=np.int64)
        return np.concatenate([[0], np.cumsum(ones)]).astype("<u4")

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        planes, zeros, at = [], [], np.asarray(ids)
        for level in range(width - 1, -1, -1):
            bit = (at & at.dtype.type(1 << level)) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            low = np.compress(~bit, at)
            zeros.append(len(low))
            at = np.concatenate([low, np.compress(bit, at)])
        return cls(len(ids), width, planes, zeros)

    def decode(self) -> np.ndarray:
        at = np.zeros(self.n, dtype=np.uint16 if self.width <= 16 else np.uint32)
        for level in range(self.width - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)
            up = np.empty_like(at)
            up[~bit] = at[: self.zeros[level]]
            up[bit] = at[self.zeros[level] :] | at.dtype.type(1 << (self.width - 1 - level))
            at = up
        return at

    def _rank1(self, level: int, i: int) -> int:
        plane, block = self.planes[level], i // BLOCK
        start, whole = block * (BLOCK // 8), i // 8
        ones = int(self.ranks[level][block]) + int(np.bitwise_count(plane[start:whole]).sum(dtype=np.int64))
        return ones + (int(plane[whole]) & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else ones

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.width):
            one = int(self.planes[level][i // 8]) >> (i % 8) & 1
            ones = self._rank1(level, i)
            value = value << 1 | one
            i = self.zeros[level] + ones if one else i - ones
        return value

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        start, end = 0, i
        for level in range(self.width):
            s, e = self._rank1(level, start), self._rank1(level, end)
            if symbol >> (self.width - 1 - level) & 1:
                start, end = self.zeros[level] + s, self.zeros[level] + e
            else:
                start, end = start - s, end - e
        return start, end

    def rank(self, symbol: int, i: int | None = None) -> int:
        """Occurrences of ``symbol`` among the first ``i`` values (all by default)."""
        if symbol >> self.width:
            return 0
        start, end = self._range(symbol, self.n if i is None else i)
        return end - start

    def select(self, symbol: int, k: int) -> int:
        """Place of the ``k``-th occurrence, from 0; -1 if there are fewer."""
        if symbol >> self.width or not 0 <= k < self.rank(symbol):
            return -1
        at = self._range(symbol, 0)[0] + k
        for level in range(self.width - 1, -1, -1):
            one = symbol >> (self.width - 1 - level) & 1
            want = at - self.zeros[level] if one else at
            low, high = 0, self.n  # the least place whose rank passes want
            while low < high:
                mid = (low + high) // 2
                ones = self._rank1(level, mid + 1)
                if (ones if one else mid + 1 - ones) > want:
                    high = mid
                else:
                    low = mid + 1
            at = low
        return at


def write_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, width: int) -> bytes:
    """Bytes of one file: header, document table, planes and rank directories."""
    matrix = WaveletMatrix.build(ids, width)
    pack = zstandard.ZstdCompressor(level=1).compress
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8).tobytes()
    parts = [known, np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), np.array(lengths, dtype="<u8").tobytes()]
    parts += [np.array(matrix.zeros, dtype="<u8").tobytes(), *(p.tobytes() for p in matrix.planes), *(r.tobytes() for r in matrix.ranks)]
    packed = [pack(p) for p in parts]
    head = struct.pack("<8sIQQI", MAGIC, len(doc_ids), len(ids), matrix.n, width)
    return head + struct.pack(f"<{len(packed)}Q", *map(len, packed)) + b"".join(packed)


def read_shard(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, their token counts and the matrix; bytes after the end are ignored."""
    magic, docs, _, n, width = struct.unpack_from("<8sIQQI", data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at, count = struct.calcsize("<8sIQQI"), 4 + 2 * width
    sizes = struct.unpack_from(f"<{count}Q", data, at)
    at += 8 * count
    parts, unpack = [], zstandard.ZstdDecompressor().decompress
    for s in sizes:
        parts.append(unpack(data[at : at + s]))
        at += s
    known, raw = np.frombuffer(parts[0], np.uint8), np.frombuffer(parts[1], "<i8")
    doc_ids = [int(d) if k else None for k, d in zip(known, raw, strict=True)]
    planes = [np.frombuffer(p, np.uint8) for p in parts[4 : 4 + width]]
    ranks = [np.frombuffer(p, "<u4") for p in parts[4 + width :]]
    assert len(doc_ids) == docs
    return doc_ids, np.frombuffer(parts[2], "<u8").astype(np.int64), WaveletMatrix(n, width, planes, np.frombuffer(parts[3], "<u8").tolist(), ranks)


def byte_letters() -> dict[int, str]:
    """Byte -> the visible letter that byte-level vocabularies write for it.

    Printable bytes stand for themselves; the others, in order, for U+0100 and on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Whole-text ids from a tokenizers file, each distinct chunk encoded once.

    For tokenizers that drop white space and never join across it, a text's ids
    are those of its white-space-separated chunks in order.  Arrow splits a batch
    of texts and numbers its distinct chunks; the library encodes those that are new; the memo forgets its older half when full.  Chunks
    of plain letters with closing marks go straight to the library's merge
    model where a probe of the file shows that its rules allow that.
    """

    MEMO = 700_000
    #: Letters that NFC leaves alone and that lower-case one to one, then marks that join no letter.
    PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.width = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.letters = byte_letters()
        self.marks: dict[str, bytes] = {}
        self.bytes_of = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.tokenizer.get_vocab_size())]
        probe = ["Straße", "ÉCOLE,", "Of...", "naïve?!", "thInk", "qzxvu;", "ÿÀö"]
        self.plain = all(self._direct(w) == np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype=self.dtype).tobytes() for w in probe)
        self.new.clear()

    def _part(self, piece: str, raw: bytes) -> bytes:
        shown = piece if len(raw) == len(piece) else raw.decode("latin-1").translate(self.letters)
        return b"".join([self.bytes_of[t.id] for t in self.tokenizer.model.tokenize(shown)])

    def _direct(self, chunk: str) -> bytes | None:
        """Ids of a plain word with its marks; the lower-case word is remembered too."""
        m = self.PLAIN.fullmatch(chunk)
        if m is None:
            return None
        word, marks = m.groups()
        word = word.lower()
        ids = self.new.get(word) or self.old.get(word) or self._part(word, word.encode())
        self.new[word] = ids
        if marks:
            if marks not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks.clear()
                self.marks[marks] = self._part(marks, marks.encode())
            ids += self.marks[marks]
        return ids

    def chunks(self, words: list[str]) -> list[bytes]:
        """Ids of each of distinct chunks."""
        got = list(map(self.new.get, words))
        missing = [i for i, x in enumerate(got) if x is None]
        if len(self.new) + len(missing) > self.MEMO:
            self.old, self.new = self.new, {}
        new, old, rest = self.new, self.old, []
        for i in missing:
            w = words[i]
            ids = old.get(w)
            if ids is None and self.plain:
                ids = self._direct(w)
            if ids is None:
                rest.append(i)
            else:
                got[i] = new[w] = ids
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            got[i] = new[words[i]] = np.array(e.ids, dtype=self.dtype).tobytes()
        return got

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids end."""
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        spread = words.flatten().dictionary_encode()
        known = self.chunks(spread.dictionary.to_pylist())
        size = np.array([len(k) for k in known], dtype=np.int64) // self.dtype.itemsize
        flat, first = np.frombuffer(b"".join(known), dtype=self.dtype), np.cumsum(size) - size
        at = spread.indices.to_numpy()
        n = size[at]
        ends = np.cumsum(n)
        ids = flat[np.repeat(first[at] - (ends - n), n) + np.arange(n.sum())]
        per_text = words.offsets.to_numpy().astype(np.int64)
        return ids, np.concatenate([[0], ends])[per_text[1:] - per_text[0]]

    def text(self, text: str) -> bytes:
        return self.batch(pa.array([text], pa.string()))[0].tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One to a worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(batch: pa.RecordBatch, column: int, rows: int = 4096, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most ``rows`` rows and, beyond one row, about ``size`` bytes of a text column."""
    lengths = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = lengths[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(lengths, before + size, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS, range_rows: int = RANGE_ROWS) -> str:
    """Encode every row and write shard files in ascending id order; returns their folder.

    Null ids come first and null texts count as empty (the end id alone).
    Repeated ids keep all their rows.  The driver sees the bounds of the ranges
    (at most ``MOST_RANGES``) and no rows.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    ranges = min(MOST_RANGES, max(1, -(-ids.count() // range_rows)))
    cuts = ids.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 100_000)).first()[0] if ranges > 1 else []
    cuts = np.unique(np.array(cuts or [], dtype=np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for big in batches:
            for b in slices(big, 1):
                ids, ends = enc.batch(b.column(1))
                raw, starts = ids.tobytes(), np.concatenate([[0], ends[:-1]]) * enc.dtype.itemsize
                parts = [raw[s:e] + end for s, e in zip(starts.tolist(), (ends * enc.dtype.itemsize).tolist(), strict=True)]
                names = b.column(0).to_pylist()
                shards = [0 if i is None else int(np.searchsorted(cuts, i, side="right")) for i in names]
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(names, pa.int64()), pa.array(parts, pa.binary())], ["shard", "id", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        at, seq, names, lengths, parts, held = None, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(parts), dtype=enc.dtype)
            blob = write_shard(names, lengths, flat, enc.width)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(flat)], pa.int64()), pa.array([blob], pa.binary())], ["shard", "seq", "n", "blob"])

        for b in batches:
            for shard, i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if names and (shard != at or held >= file_ids):
                    yield flush()
                    seq = seq + 1 if shard == at else 0
                    names, lengths, parts, held = [], [], [], 0
                at = shard
                data = raw.as_py()
                names.append(i)
                parts.append(data)
                lengths.append(len(data) // enc.dtype.itemsize)
                held += lengths[-1]
        if names:
            yield flush()

    out = shared_dir(spark, "tokens")
    encoded = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(encode, "shard int, id long, ids binary")
    sorted_ = encoded.repartition("shard").sortWithinPartitions("shard", F.asc_nulls_first("id"), "ids")
    blobs = sorted_.mapInArrow(pack, "shard int, seq int, n long, blob binary")
    lines = blobs.select("shard", "seq", "n", F.col("blob").cast("string").alias("value"))
    lines.write.partitionBy("shard", "seq", "n").option("maxRecordsPerFile", 1).text(out)
    return out


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` per document, decoded from the files.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is over the
    ids as little-endian unsigned 32-bit integers.  An empty folder gives no rows.
    """
    ensure_importable(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, seq, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                names, lengths, matrix = read_shard(content.as_py())
                ids, ends = matrix.decode().astype("<u4"), np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                k = len(names)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * k, pa.int32()), pa.array([seq] * k, pa.int32()), pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["shard", "seq", "id", "at", "n", "crc"])

    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").schema(schema).load(folder)
    number = lambda name, kind: F.regexp_extract("path", f"/{name}=([0-9]+)/", 1).cast(kind).alias(name)
    files = found.select(number("shard", "int"), number("seq", "int"), number("n", "long"), "content")
    sizes = files.select("shard", "seq", "n")
    by_shard = sizes.groupBy("shard").agg(F.sum("n").alias("total"))
    # MOST_RANGES rows at most meet in this window, whatever the corpus
    before = by_shard.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    within = sizes.select("shard", "seq", (F.sum("n").over(Window.partitionBy("shard").orderBy("seq")) - F.col("n")).alias("inside"))
    offsets = within.join(before, "shard").select("shard", "seq", (F.col("before") + F.col("inside")).alias("base"))
    rows = files.select("shard", "seq", "content").mapInArrow(decode, "shard int, seq int, id long, at long, n long, crc long")
    joined = rows.join(offsets, ["shard", "seq"])
    return joined.select(F.col("id").alias(id_col), (F.col("base") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
