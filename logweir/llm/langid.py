"""Language identification by rank-order n-gram profiles.

A profile lists a language's most frequent letter n-grams by rank.  A document
gets the language whose profile has the least out-of-place distance to the
document's own ranking; an n-gram that a profile lacks counts as far as the
profile is long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import ensure_importable

#: n-grams in a profile, their longest length, labelled documents learned from per language.
PROFILE, LONGEST, DOCS_PER_LANG = 400, 3, 5000
_FLUSH = 400_000
BOUND = 1

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in ascending code and their counts.

    Text is lower-cased; what lies between runs of letters is one boundary,
    written 1, which no letter is.  An n-gram packs its code points in 21 bits
    each, so lengths never clash.
    """
    none = np.array([], dtype=np.int64)
    if not text:
        return none, none
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    letter = _is_letter()[codes]
    if not letter.any():
        return none, none
    codes = np.concatenate([[BOUND], np.where(letter, codes, BOUND), [BOUND]])
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != BOUND) | (codes[:-1] != BOUND)
    codes = codes[keep]
    found, packed = [codes[codes != BOUND]], codes
    for n in range(2, LONGEST + 1):
        packed = (packed[:-1] << 21) | codes[n - 1 :]
        inner = np.ones(len(packed), dtype=bool)  # no n-gram runs across a boundary
        for i in range(1, n - 1):
            inner &= codes[i : i + len(packed)] != BOUND
        found.append(packed[inner])
    every = np.concatenate(found)
    every.sort()
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[first], np.diff(np.concatenate([first, [len(every)]]))


def ranking(text: str | None, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, ties by ascending code."""
    codes, n = grams(text)
    return codes[np.argsort(-n, kind="stable")[:size]]


class Profiles:
    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE):
        self.size, self.langs = size, sorted(ranked)
        self.codes = np.unique(np.array([g for v in ranked.values() for g in v], dtype=np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, dtype=np.int64)
        for k, lang in enumerate(self.langs):
            own = np.array(ranked[lang], dtype=np.int64)
            self.ranks[np.searchsorted(self.codes, own), k] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        mine = ranking(text, self.size)
        if not len(mine) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.codes, mine)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != mine)] = len(self.codes)
        theirs = self.ranks[at]
        off = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(mine))[:, None]))
        total = off.sum(axis=0)
        best = int(total.argmin())
        return self.langs[best], float(1 - total[best] / (len(mine) * self.size))


def learn(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG, size: int = PROFILE) -> Profiles:
    """Profiles from ``labelled(id, text, lang)``.

    A language with more rows than ``docs_per_lang`` is learned from the rows
    whose hashed id falls in the matching share.  The driver receives ``size``
    n-grams a language.
    """
    ensure_importable(labelled.sparkSession)
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Profiles({}, size)
    share = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, docs_per_lang / n)))))
    unit = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000
    rows = labelled.where(unit < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], int] = {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in held], pa.string()), "g": pa.array([k[1] for k in held], pa.int64()), "n": pa.array(list(held.values()), pa.int64())})

        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                codes, n = grams(t.as_py())
                for c, k in zip(codes.tolist(), n.tolist(), strict=True):
                    held[lang, c] = held.get((lang, c), 0) + k
            if len(held) > _FLUSH:
                yield flush()
                held = {}
        if held:
            yield flush()

    total = rows.mapInArrow(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    top = total.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "g"))).where(F.col("r") <= size)
    ranked: dict[str, list[tuple[int, int]]] = {}
    for r in top.select("lang", "g", "r").collect():
        ranked.setdefault(r["lang"], []).append((r["r"], r["g"]))
    return Profiles({k: [g for _, g in sorted(v)] for k, v in ranked.items()}, size)


def identify(docs: DataFrame, profiles: Profiles, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` and ``lang_pred, score`` for each row.

    ``lang_pred`` is ``und`` with score 0 if the text is null or has no letter,
    or if nothing was learned.  Equal distances go to the first language by
    name.  Repeated rows each come back; an empty table gives no rows.
    """
    ensure_importable(docs.sparkSession)
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(F.col(text_col).cast("string").alias("t"), *(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [profiles.predict(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*names, "lang_pred", "score"])

    schema = ", ".join([*(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names), "lang_pred string, score double"])
    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "lang_pred", "score")


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id counts as no text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
