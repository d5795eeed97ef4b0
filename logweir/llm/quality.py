"""Quality rules: base counts of a text, and robust outliers per language and source.

Rows that pass the base rule are vectors of transformed statistics: log mean
word length, log share of signs, log share of repeated words in ten-word pieces,
log odds of vowels among letters, log words a line.  Short texts scatter by
chance, so a text of ``n`` words is taken to scatter ``1 + SHORT / n`` times as
widely as a very long one.  Location and scatter come from the minimum
covariance determinant: from three deterministic starts, concentration steps
keep the ``SUBSET`` of a group's rows nearest by Mahalanobis distance and
estimate anew; the start that ends with the least determinant goes on.  Scatter
is made consistent for normal rows and gets a ridge, a small share of the pooled
scatter.  A row is rejected beyond the chi-square quantile that normal rows pass
once in a million.

Every language and source has its own estimate, every language one and all rows
one.  A group's estimate is the mean of its own and the next wider one, weighted
by its rows against ``PRIOR`` rows, so that small groups lean on their language
and no size is treated unlike another.  Each step is one quantile and one
aggregation of sums per group, so a group of any size is pre-aggregated where
its rows are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import ensure_importable, materialize, quoted

SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("word_length", "signs", "repeats", "vowels", "line_words")
PIECE = 10
#: Share of a group's rows in the concentrated subset; concentration steps from every start, and further ones from the best.
SUBSET, STEPS, MORE_STEPS = 0.75, 2, 4
#: Words at which a text scatters twice as widely as a very long one; rows that the wider group's estimate counts for;
#: share of the pooled variances that is added to a scatter; chance at which a normal row is rejected.
SHORT, PRIOR, RIDGE, CHANCE = 200.0, 50.0, 0.02, 1e-6

_SPACES = "\t\n\x0b\x0c\r "
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_LETTERS = bytes(c for c in range(128) if chr(c).isalpha())
_VOWELS = b"aeiouyAEIOUY"


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()  # bytes split at exactly the six ASCII spaces
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in _SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    dup = 0
    if "\n" in text:
        seen: set[str] = set()
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif line.strip(_SPACES):
                seen.add(line)
    repeat = 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(windows)) < len(windows):
            times, upto = Counter(windows), 0
            for i, w in enumerate(windows):
                if times[w] > 1:
                    repeat += i + WINDOW - max(i, upto)
                    upto = i + WINDOW
    return n, chars, symbols, dup, repeat


def marks(text: str | None) -> tuple[int, int, int, int, int, int]:
    """ASCII signs, letters and vowels, distinct words of each whole piece of ``PIECE`` words, words in such pieces, lines."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, size = raw.split(), len(raw)
    signs, letters, vowels = (size - len(raw.translate(None, kind)) for kind in (_SIGNS, _LETTERS, _VOWELS))
    whole = len(words) // PIECE * PIECE
    distinct = sum(len(set(words[i : i + PIECE])) for i in range(0, whole, PIECE))
    return signs, letters, vowels, distinct, whole, raw.count(b"\n") + 1


def vectors(counted: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Weight and features of each row of ``counts`` and ``marks``: finite for every text."""
    n, chars = counted[:, 0].astype(float), counted[:, 1].astype(float)
    signs, letters, vowels, distinct, whole, lines = marked.astype(float).T
    x = [
        np.log(np.maximum(chars, 1) / np.maximum(n, 1)), np.log((signs + 0.5) / (chars + 1)), np.log((whole - distinct + 1) / (whole + 1)),
        np.log((vowels + 0.5) / (letters - vowels + 0.5)), np.log((n + 1) / lines),
    ]
    return np.stack([n / (n + SHORT), *x], axis=1)


def add_counts(docs: DataFrame, text_col: str, names: tuple[str, ...], weight: str | None = None, x: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with the five counts of each text under ``names``, and its weight and features if named."""
    ensure_importable(docs.sparkSession)
    at, more = docs.columns.index(text_col), [weight, *x] if weight else []
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names), *(T.StructField(n, T.DoubleType()) for n in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(at)]
            found = np.array([counts(t) for t in texts], dtype=np.int64).reshape(-1, len(names))
            new = [pa.array(found[:, i]) for i in range(len(names))]
            if more:
                v = vectors(found, np.array([marks(t) for t in texts], dtype=np.int64).reshape(-1, 6))
                new += [pa.array(v[:, i]) for i in range(v.shape[1])]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *names, *more])

    return docs.mapInArrow(run, schema)


def chi2_share(x: float, k: int) -> float:
    """Chance that a chi-square of ``k`` degrees of freedom is at most ``x``."""
    if x <= 0:
        return 0.0
    term = total = 1 / math.gamma(k / 2 + 1)
    i = 1
    while term > 1e-17 * total:
        term *= x / 2 / (k / 2 + i)
        total += term
        i += 1
    return math.exp(-x / 2 + k / 2 * math.log(x / 2)) * total


def chi2_quantile(share: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_share(mid, k) < share else (low, mid)
    return low


def distance(x: list[Column], weight: Column, loc: Column, prec: Column) -> Column:
    """Squared Mahalanobis distance of a row whose scatter is the group's over ``weight``."""
    p = len(x)
    d = [x[i] - loc[i] for i in range(p)]
    terms = [d[i] * d[j] * prec[i * p + j] * (1.0 if i == j else 2.0) for i in range(p) for j in range(i, p)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return weight * out


def _upper(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def square(values: list[float], p: int) -> np.ndarray:
    """The symmetric matrix of an upper triangle in rows."""
    out = np.zeros((p, p))
    for (i, j), v in zip(_upper(p), values, strict=True):
        out[i, j] = out[j, i] = v
    return out


_FIT = "g string, start int, n double, loc array<double>, cov array<double>, prec array<double>, det double"


def _fits(rows: list[tuple]) -> pd.DataFrame:
    """Fits from ``(g, start, n, location, scatter)``."""
    out = [(g, start, n, loc.tolist(), c.ravel().tolist(), np.linalg.inv(c).ravel().tolist(), float(np.linalg.slogdet(c)[1])) for g, start, n, loc, c in rows]
    return pd.DataFrame(out, columns=["g", "start", "n", "loc", "cov", "prec", "det"])


def _begin(p: int, ridge: np.ndarray):
    """The three starts: median deviations, the scatter of damped rows and that of directions."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                loc, s = np.array([float(v) for v in r.mid]), np.sqrt(np.array([float(v) for v in r.dev]) ** 2 + np.diag(ridge))
                for start, c in enumerate((np.eye(p), square(r.damped, p) / r.n, square(r.turned, p) / r.n * p)):
                    rows.append((r.g, start, float(r.n), loc, c * np.outer(s, s) + ridge))
            yield _fits(rows)

    return run


def _refit(p: int, ridge: np.ndarray, factor: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                loc = np.array(r.s, dtype=float) / r.w
                c = factor * (square(r.q, p) - r.w * np.outer(loc, loc)) / r.near
                rows.append((r.g, r.start, float(r.n), loc, (c + c.T) / 2 + ridge))
            yield _fits(rows)

    return run


def _sums(weight: Column, x: list[Column]) -> list[Column]:
    p = len(x)
    return [F.sum(weight).alias("w"), F.array(*(F.sum(weight * c) for c in x)).alias("s"), F.array(*(F.sum(weight * x[i] * x[j]) for i, j in _upper(p))).alias("q")]


def _totals(rows: DataFrame, aggregates: list[Column], *keys: str) -> DataFrame:
    """``aggregates`` of each group ``g`` and ``keys``, pre-aggregated wherever a join left its rows.

    Grouped by the reversed name: a join that deals rows by ``g`` (fits too many
    to broadcast) must not have its dealing used again, as that would bring all
    rows of a group to one task, those of the group of all rows too.
    """
    return rows.groupBy(F.reverse("g").alias("g"), *keys).agg(*aggregates).withColumn("g", F.reverse("g"))


def determinant_fits(data: DataFrame, x: list[str], weight: str, scale: list[float], subset: float = SUBSET, ridge: float = RIDGE, steps: int = STEPS, more_steps: int = MORE_STEPS) -> DataFrame:
    """``(g, n, loc, cov)``: the minimum-covariance-determinant estimate of each group ``g`` of ``data``."""
    p, cols, w = len(x), [F.col(c) for c in x], F.col(weight)
    floor = ridge * np.diag(np.square(scale))
    factor = subset / chi2_share(chi2_quantile(subset, p), p + 2)
    mid = materialize(data.groupBy("g").agg(F.array(*(F.percentile_approx(c, 0.5, 1000) for c in cols)).alias("mid"), F.count(F.lit(1)).alias("n")), "mcd-mid")
    off = [F.sqrt(w) * (cols[i] - F.col("mid")[i]) for i in range(p)]
    dev = _totals(data.join(mid, "g"), [F.array(*(F.percentile_approx(F.abs(o), 0.5, 1000) * 1.4826 for o in off)).alias("dev")])
    spread = materialize(mid.join(dev, "g"), "mcd-dev")
    z = [(off[i] / F.sqrt(F.pow(F.col("dev")[i], 2) + float(floor[i, i]))).alias(f"z{i}") for i in range(p)]
    scaled = data.join(spread, "g").select("g", *z)
    length = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(p)), F.lit(0.0))
    damped = [F.sum(F.tanh(f"z{i}") * F.tanh(f"z{j}")) for i, j in _upper(p)]
    turned = [F.sum(F.col(f"z{i}") * F.col(f"z{j}") / F.greatest(length, F.lit(1e-12))) for i, j in _upper(p)]
    sums = _totals(scaled, [F.array(*damped).alias("damped"), F.array(*turned).alias("turned")])
    fit = materialize(spread.join(sums, "g").mapInPandas(_begin(p, floor), _FIT), "mcd-start")
    for step in range(steps + more_steps):
        if step == steps:
            best = fit.groupBy("g").agg(F.min_by(F.struct(*fit.columns[1:]), F.struct("det", "start")).alias("b"))
            fit = materialize(best.select("g", "b.*"), "mcd-best")
        far = data.join(fit.select("g", "start", "n", "loc", "prec"), "g").withColumn("far", distance(cols, w, F.col("loc"), F.col("prec")))
        cut = materialize(_totals(far, [F.percentile_approx("far", subset, 1000).alias("cut")], "start"), f"mcd-cut{step}")
        near = far.join(cut, ["g", "start"]).where(F.col("far") <= F.col("cut"))
        sums = _totals(near, [F.first("n").alias("n"), F.count(F.lit(1)).alias("near"), *_sums(w, cols)], "start")
        fit = materialize(sums.mapInPandas(_refit(p, floor, factor), _FIT), f"mcd-fit{step}")
    return fit.select("g", "n", "loc", "cov")


def _lean(wider: tuple, prior: float):
    """Each group's location and precision, leaning on its language's and that on the estimate of all rows."""

    def toward(n: float, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        return (n * own + prior * other) / (n + prior)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            loc, prec = [], []
            for r in f.itertuples():
                made = []
                for own, lang, every in zip((r.loc0, r.cov0), (r.loc1, r.cov1), wider, strict=True):
                    made.append(toward(r.n0, np.array(own, dtype=float), toward(r.n1, np.array(lang, dtype=float), np.array(every, dtype=float))))
                p = len(made[0])
                loc.append(made[0].tolist())
                prec.append(np.linalg.inv(made[1].reshape(p, p)).ravel().tolist())
            yield pd.DataFrame({"g0": f["g0"], "loc": loc, "prec": prec})

    return run


def estimates(rows: DataFrame, lang: str, source: str, x: list[str], weight: str, prior: float = PRIOR, **how) -> DataFrame:
    """``(lang, source, loc, prec)`` of each language and source of ``rows``.

    Null keys are values of their own.  Empty ``rows`` give no estimates.
    """
    spark = rows.sparkSession
    ensure_importable(spark)
    keep = {"ignoreNullFields": "false"}
    keys = [F.to_json(F.struct(F.col(lang).alias("l"), F.col(source).alias("s")), keep), F.to_json(F.struct(F.col(lang).alias("l")), keep), F.lit("")]
    data = materialize(rows.select(F.explode(F.array(*keys)).alias("g"), weight, *x), "mcd-rows")
    groups = materialize(rows.groupBy(lang, source).agg(F.first(keys[0]).alias("g0"), F.first(keys[1]).alias("g1")), "mcd-groups")
    spread = rows.agg(*(F.stddev_pop(c).alias(c) for c in x)).first()
    fits = materialize(determinant_fits(data, x, weight, [max(spread[c] or 0.0, 1e-6) for c in x], **how), "mcd-fits")
    every = fits.where(F.col("g") == "").first()
    if every is None:
        every = {"loc": [], "cov": []}
    own, wide = (fits.select(F.col("g").alias(f"g{i}"), *(F.col(c).alias(f"{c}{i}") for c in ("n", "loc", "cov"))) for i in (0, 1))
    pairs = groups.select("g0", "g1").join(own, "g0").join(wide, "g1")
    made = materialize(pairs.mapInPandas(_lean((every["loc"], every["cov"]), prior), "g0 string, loc array<double>, prec array<double>"), "mcd-made")
    return groups.join(made, "g0").select(lang, source, "loc", "prec")


def judge(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chance: float = CHANCE, prefix: str = "") -> DataFrame:
    """``keep`` columns with the counts, ``base_failed``, ``distance`` and ``kept`` of each row.

    ``base_failed``: under 10 words, or over a fifth of the words in repeated
    5-word windows.  Null and empty texts have no words; very long ones are
    counted whole.  Null languages and sources are groups like any other, repeated
    rows count each time, an empty table gives no rows.  Rows at exactly the limit
    stay.  ``distance`` may be null where ``base_failed``.  New columns take
    ``prefix`` so that they clash with none of ``keep``.
    """
    n = {c: f"{prefix}{c}" for c in (*COUNTS, "base_failed", "distance", "kept")}
    inner = {c: f"__q{i}" for i, c in enumerate(COUNTS)}
    slots = [f"__k{i}" for i in range(len(keep))]
    source = docs.select(*(quoted(c).alias(s) for c, s in zip(keep, slots, strict=True)), quoted(lang_col).alias("__l"), quoted(source_col).alias("__s"), quoted(text_col).cast("string").alias("__t"))
    x = [f"__x{i}" for i in range(len(FEATURES))]

    def counted(df: DataFrame) -> DataFrame:
        return add_counts(df, "__t", tuple(inner.values()), "__w", tuple(x)).drop("__t")

    words, repeats = F.col(inner["n_words"]), F.col(inner["n_repeat_words"])
    failed = (words < 10) | (100 * repeats > 20 * words)
    narrow = text_col not in keep
    rows = materialize(counted(source), "quality") if narrow else counted(source)
    stats = rows if narrow else materialize(counted(source.select("__l", "__s", "__t")), "quality")
    fits = estimates(stats.where(~failed).select("__l", "__s", "__w", *x), "__l", "__s", x, "__w")
    fits = materialize(fits.withColumnsRenamed({"__l": "__fl", "__s": "__fs"}), "quality-fits")
    joined = rows.join(fits, rows["__l"].eqNullSafe(fits["__fl"]) & rows["__s"].eqNullSafe(fits["__fs"]), "left")
    far = distance([F.col(c) for c in x], F.col("__w"), F.col("loc"), F.col("prec"))
    verdict = ~failed & (F.coalesce(far, F.lit(0.0)) <= chi2_quantile(1 - chance, len(x)))
    return joined.select(*(F.col(s).alias(c) for c, s in zip(keep, slots, strict=True)), *(F.col(inner[c]).alias(n[c]) for c in COUNTS), failed.alias(n["base_failed"]), far.alias(n["distance"]), verdict.alias(n["kept"]))
