"""Mixing to target weights with soft domain membership, in built-in functions only.

A naive Bayes classifier, counted from labelled documents, gives each document
posteriors over domains.  Nonnegative document rates then minimise the squared
gap between expected domain token totals and their targets by projected
gradient steps, and where these are slow by implicit ones, whose lengths a
Newton search over the few domain multipliers finds: each step is one
aggregation over the documents to a few numbers for each pair of domains.
"""

from __future__ import annotations

import json
import logging
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import WORD_SPACE, hidden, materialize, quoted

#: Hash buckets of features; expected labelled documents learned from; likelihood-ratio statistic
#: at which a bucket's log odds get half of their weight to the power POWER (chance alone has a mean of 1).
BUCKETS, TRAIN_DOCS, EVIDENCE, POWER = 65_536, 8000, 10.0, 4
#: Weight of the absence of a bucket: most absences go together, as those of all marks of junk do.
ABSENCE = 0.3
#: Document frequency of the whole sample that smooths each domain's own, in documents.
SMOOTHING = 5.0
STEPS, TOLERANCE = 25, 1e-4
#: Implicit steps are as long as the inverse of each of these gradient steps, until the tolerance is met, and Newton
#: steps of each at most.  What the last one leaves, no rates that are not huge can close.
DAMPINGS, SEARCH = (1e-4, 1e-6, 1e-8, 1e-10), 60

#: ASCII signs as a part of a character class: classes within Latin-1 are quick bit sets.
SIGNS = "!-/:-@\\[-^`{-~"
#: Posteriors are whole multiples of one part in so many: documents with equal ones have equal rates, so rates are fitted
#: to the sums of tokens of each posterior, at most 501,501 of three domains, however many documents there are.
GRID = 1000

_LOG = logging.getLogger(__name__)


def _bucket(kind: str, value: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(kind), value), F.lit(BUCKETS)).cast("int")


def with_features(docs: DataFrame, text_col: str, count: str, held: str) -> DataFrame:
    """``docs`` with the number of words of ``text_col`` as ``count`` and its distinct buckets as ``held``.

    Words are runs of neither white space nor ASCII signs.  Buckets are of each
    word in lower case, of runs of signs, and of shares: distinct words, runs of
    signs and of capitals for each word, distinct lines.  Each pattern runs once
    over a text.
    """
    h = hidden([*docs.columns, count, held])
    t, w, s, v, m = (f"{h}f{x}" for x in "twsvm")
    out = docs.withColumn(t, F.coalesce(quoted(text_col).cast("string"), F.lit("")))
    out = out.withColumns({
        w: F.array_remove(F.split(F.lower(t), f"[{WORD_SPACE}{SIGNS}]+"), ""),
        s: F.regexp_extract_all(t, F.lit(f"[{SIGNS}]+"), F.lit(0)),
        m: F.split(t, "\n"),
    })
    out = out.withColumn(v, F.array_distinct(w))
    n = F.greatest(F.size(w), F.lit(1))
    odd = F.size(F.array_remove(F.array_remove(s, "."), ","))
    capitals = F.regexp_count(t, F.lit("[A-Z\u00c0-\u00d6\u00d8-\u00de]{2,}"))
    shares = {"d": 10 * F.size(v) / n, "y": 5 * odd / n, "u": 5 * capitals / n, "l": 5 * F.size(F.array_distinct(m)) / F.size(m)}
    doc = F.when(F.size(w) + F.size(s) > 0, F.array(*(_bucket(k, F.floor(x)) for k, x in shares.items()))).otherwise(F.array().cast("array<int>"))
    found = F.concat(F.transform(v, lambda x: _bucket("w", x)), F.transform(F.array_distinct(s), lambda x: _bucket("s", x)), doc)
    return out.withColumns({count: F.size(w).cast("long"), held: F.array_distinct(found)}).drop(t, w, s, v, m)


def _total(model: Column, buckets: Column) -> Column:
    return F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + F.get(model, b))


class DomainModel:
    """Priors, and per bucket and domain the evidence of its presence against the mean of all domains.

    ``base`` is the evidence of a document that has none of the buckets, ``length``
    the mean characters of those learned from.  Longer texts have more buckets of
    every kind, so their evidence counts in proportion to ``length``.
    """

    def __init__(self, domains: list[str], priors: list[float], base: list[float], odds: list[list[float]], length: float = math.inf):
        self.domains, self.priors, self.base, self.odds, self.length = domains, priors, base, odds, length

    def logits(self, held: Column, text: Column) -> Column:
        """The logits over ``domains`` from a text and its distinct buckets, less that of the last.

        Only differences count in a posterior, so one sum is spared.
        """
        scale = F.least(F.lit(1.0), F.lit(self.length) / F.greatest(F.coalesce(F.length(text.cast("string")), F.lit(0)), F.lit(1)))
        logits = []
        for prior, base, odds in zip(self.priors[:-1], self.base[:-1], self.odds[:-1], strict=True):
            model = F.from_json(F.lit(json.dumps([round(x - y, 5) for x, y in zip(odds, self.odds[-1], strict=True)])), "array<double>")
            logits.append(F.lit(math.log(prior / self.priors[-1])) + scale * (F.lit(base - self.base[-1]) + _total(model, held)))
        return F.array(*logits, F.lit(0.0))


def softmax(logits: Column, k: int) -> Column:
    top = F.array_max(logits)
    e = [F.exp(F.greatest(logits[i] - top, F.lit(-60.0))) for i in range(k)]
    total = e[0]
    for x in e[1:]:
        total = total + x
    return F.array(*(x / total for x in e))


def on_grid(p: Column) -> Column:
    """Posteriors rounded down to the grid; what is left over goes to the greatest, the first of equal ones."""
    units = F.transform(p, lambda x: F.floor(x * GRID))
    left = F.lit(GRID) - F.aggregate(units, F.lit(0).cast("long"), lambda a, x: a + x)
    top = F.array_position(p, F.array_max(p)) - 1
    return F.transform(units, lambda x, i: (x + F.when(i == top, left).otherwise(0)) / GRID)


def likelihood_ratio(n: np.ndarray, held: np.ndarray) -> np.ndarray:
    """G statistic of the document frequencies ``n`` (sets x buckets) among ``held`` documents a set."""
    expected = held[:, None] * n.sum(axis=0) / max(held.sum(), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        have = np.where(n > 0, n * np.log(n / expected), 0)
        lack = np.where(held[:, None] > n, (held[:, None] - n) * np.log((held[:, None] - n) / (held[:, None] - expected)), 0)
    return 2 * (have + lack).sum(axis=0)


def domain_model(domains: list[str], n: np.ndarray, held: np.ndarray, length: float = math.inf) -> DomainModel:
    """The model of document frequencies ``n`` (domains x buckets) among ``held`` documents a domain.

    A bucket's evidence for a domain is the log of its frequency there over the
    geometric mean of all domains, shrunken by how surely the domain differs from the others
    together: by ``(G / (G + EVIDENCE)) ** POWER`` of the likelihood-ratio statistic,
    as the many rare words would drown the others in noise.  All domains are
    treated alike, so their order and names do not matter.
    """
    prior = (held + 1) / (held + 1).sum()
    pooled = n.sum(axis=0) / max(held.sum(), 1)
    p = np.clip((n + SMOOTHING * pooled) / (held[:, None] + SMOOTHING), 1e-5, 1 - 1e-5)
    mean = np.exp(np.log(p).mean(axis=0))
    g = np.stack([likelihood_ratio(np.stack([n[k], n.sum(axis=0) - n[k]]), np.array([held[k], held.sum() - held[k]])) for k in range(len(domains))])
    weight = (g / (g + EVIDENCE)) ** POWER
    present, absent = np.log(p / mean) * weight, ABSENCE * np.log((1 - p) / (1 - mean)) * weight
    return DomainModel(domains, prior.tolist(), absent.sum(axis=1).tolist(), (present - absent).tolist(), length)


def learn_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> DomainModel:
    """Count a naive Bayes model of feature presence from ``labelled(id, domain)`` joined to ``docs``.

    Of more than ``train_docs`` labelled rows, those are learned from whose
    hashed id falls in the matching share; that side of the join is then
    bounded and is broadcast.  The driver gets one number for each bucket and
    domain.  Without labels all domains are alike, and a
    repeated label counts once, so that no id can swell the broadcast.
    """
    labelled = labelled.where(quoted(id_col).isNotNull() & F.col("domain").isin(domains)).select(quoted(id_col).alias("id"), "domain").distinct()
    share = min(1.0, train_docs / max(1, labelled.count()))
    sample = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    texts = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("t"))
    rows = texts.join(F.broadcast(sample), "id")
    present = with_features(rows, "t", "n_", "held").select("domain", F.explode_outer("held").alias("b")).where("b IS NOT NULL")  # explode has its input computed once more, in a filter
    counted = {(r["domain"], r["b"]): r["n"] for r in present.groupBy("domain", "b").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = {r["domain"]: (r["n"], r["chars"]) for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).alias("chars")).collect()}
    held = np.array([sizes.get(d, (0, 0))[0] for d in domains], dtype=float)
    length = max(1.0, sum(c for _, c in sizes.values()) / max(1.0, held.sum()))
    n = np.zeros((len(domains), BUCKETS))
    for (d, b), k in counted.items():
        n[domains.index(d), b] = k
    return domain_model(domains, n, held, length)


def memberships(docs: DataFrame, model: DomainModel, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """``keep``, ``n_tokens`` (words) and ``p`` (posteriors over the model's domains) of each row."""
    slots = [f"__m{i}" for i in range(len(keep))]
    rows = docs.select(*(quoted(c).alias(s) for c, s in zip(keep, slots, strict=True)), quoted(text_col).alias("__t"))
    rows = with_features(rows, "__t", "__n", "__b").select(*slots, "__n", model.logits(F.col("__b"), F.col("__t")).alias("__z"))
    rows = rows.select(*slots, "__n", softmax(F.col("__z"), len(model.domains)).alias("__p"))
    return rows.select(*(F.col(s).alias(c) for c, s in zip(keep, slots, strict=True)), F.col("__n").alias("n_tokens"), on_grid(F.col("__p")).alias("p"))


def by_posterior(rows: DataFrame, n: str = "n_tokens", p: str = "p") -> DataFrame:
    """``(n_tokens, p)``: the tokens of all rows with the same posteriors."""
    sums = rows.groupBy(F.col(p).alias("p")).agg(F.sum(F.col(n)).alias("n_tokens"))
    return materialize(sums.select("n_tokens", "p"), "mix-posteriors")


def _bounded(r: Column, most: float) -> Column:
    """The projection of rates to those from zero to ``most``."""
    r = F.greatest(F.lit(0.0), r)
    return r if most == math.inf else F.least(F.lit(most), r)


def _rate(p: Column, k: int, steps: list[list[float]], most: float = math.inf) -> Column:
    """Rates after ``steps``.  They come as one array constant, so a further step compiles no new code."""
    return _bounded(_unbounded(p, k, steps, most), most) if steps else F.lit(1.0)


def _unbounded(p: Column, k: int, steps: list[list[float]], most: float = math.inf) -> Column:
    """Rates after ``steps``, the last of them without its projection."""
    taken = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")

    def step(r: Column, g: Column) -> Column:
        change = F.get(p, F.lit(0)) * F.get(g, F.lit(0))
        for i in range(1, k):
            change = change + F.get(p, F.lit(i)) * F.get(g, F.lit(i))
        return _bounded(r, most) - change

    return F.aggregate(taken, F.lit(1.0), step)


def _descend(rows: DataFrame, targets: list[float], steps: int, tolerance: float, n: str, p: str, share: float = 1.0, most: float = math.inf) -> tuple[list[list[float]], list[dict], float, np.ndarray, np.ndarray]:
    """Gradient steps taken and the gap after each, the total, the norm's matrix and the wanted shares."""
    k = len(targets)
    pc, nc = F.col(p), F.col(n).cast("double")
    first = rows.agg(F.sum(nc).alias("total"), *(F.sum(nc * pc[i] * pc[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(k))).first()
    total = first["total"] or 0.0
    if total <= 0:
        return [], [], 0.0, np.eye(k), np.zeros(k)
    m = np.array([[first[f"m{i}_{j}"] for j in range(k)] for i in range(k)]) / total
    metric = m + 1e-6 * np.trace(m) / k * np.eye(k)
    inverse = np.linalg.inv(metric)
    want = share * np.array(targets, dtype=float) / (sum(targets) or 1.0)
    taken: list[list[float]] = []
    history = []
    for _ in range(steps):
        got = rows.agg(*(F.sum(_rate(pc, k, taken, most) * nc * pc[i]).alias(f"t{i}") for i in range(k))).first()
        gap = np.array([got[f"t{i}"] or 0.0 for i in range(k)]) / total - want
        history.append({"totals": [float(got[f"t{i}"] or 0.0) for i in range(k)], "gap": float(np.abs(gap).max())})
        if history[-1]["gap"] <= tolerance:
            break
        taken.append([float(x) for x in inverse @ gap])
    return taken, history, total, metric, want


def fit_rates(rows: DataFrame, targets: list[float], steps: int = STEPS, tolerance: float = TOLERANCE, n: str = "n_tokens", p: str = "p") -> tuple[Column, list[dict]]:
    """The rate of each row of ``rows(n, p)`` after ``steps`` gradient steps as an expression, and the gap before each step.

    Minimises the gap between ``sum(rate * n * p)`` and ``targets`` (shares of
    all tokens) over rates of zero or more, in the norm given by the inverse of
    ``sum(n * p * p')``; in that norm and the token-weighted one of the rates the
    gradient's Lipschitz constant is 1, so full steps descend.  Rates start at 1.
    These are the first steps of ``reach_rates``, which goes on to the targets.
    """
    taken, history, *_ = _descend(rows, targets, steps, tolerance, n, p)
    return _rate(F.col(p), len(targets), taken), history


def reach_rates(rows: DataFrame, targets: list[float], tolerance: float = TOLERANCE, n: str = "n_tokens", p: str = "p", share: float = 1.0, most: float = math.inf) -> tuple[Column, list[dict]]:
    """Like ``fit_rates``, but until the gap is at most ``tolerance`` or the least that any rates leave.

    The mix has ``share`` of all tokens, and rates are ``most`` (1 or more) at most:
    steps are projected to that bound as they are to zero.

    Where gradient steps end short, implicit ones follow: of the lengths ``1 / DAMPINGS``,
    along the gap at their end.  Such a step minimises a convex function of one
    multiplier a domain, by Newton's method with halved steps.  The last entry of
    the history has the gap of the returned rates.
    """
    k = len(targets)
    pc, nc = F.col(p), F.col(n).cast("double")
    taken, history, total, metric, want = _descend(rows, targets, STEPS, tolerance, n, p, share, most)

    def at(multipliers: np.ndarray, damping: float) -> tuple[float, np.ndarray, np.ndarray, list[float]]:
        """The convex function, the gap, the curvature and the totals where a further step takes ``multipliers``."""
        x = rows.select(nc.alias("n"), pc.alias("p"), _unbounded(pc, k, [*taken, [float(v) for v in multipliers]], most).alias("x"))
        rate = _bounded(F.col("x"), most)
        inside, w = (F.col("x") > 0) & (F.col("x") < most), F.col("n") * rate
        sums = [F.sum(w * (2 * F.col("x") - rate)).alias("f"), *(F.sum(w * F.col("p")[i]).alias(f"t{i}") for i in range(k))]
        sums += [F.sum(F.when(inside, F.col("n") * F.col("p")[i] * F.col("p")[j]).otherwise(0.0)).alias(f"h{i}_{j}") for i in range(k) for j in range(i + 1)]
        r = x.agg(*sums).first()
        totals = [float(r[f"t{i}"] or 0.0) for i in range(k)]
        h = np.array([[r[f"h{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]) / total
        value = damping * multipliers @ metric @ multipliers / 2 + (r["f"] or 0.0) / total / 2 + want @ multipliers
        return float(value), np.array(totals) / total - want, h, totals

    if history and history[-1]["gap"] > tolerance:
        for damping in DAMPINGS:
            multipliers = np.zeros(k)
            value, gap, h, totals = at(multipliers, damping)
            for _ in range(SEARCH):
                slope = damping * metric @ multipliers - gap
                if np.abs(slope).max() <= tolerance / 10:
                    break
                change, length = np.linalg.solve(damping * metric + h, -slope), 1.0
                found = at(multipliers + change, damping)
                while found[0] > value + 1e-4 * length * float(slope @ change) + 1e-13 * abs(value) and length > 1e-6:
                    length /= 2
                    found = at(multipliers + length * change, damping)
                multipliers = multipliers + length * change
                value, gap, h, totals = found
            taken.append([float(v) for v in multipliers])
            history.append({"totals": totals, "gap": float(np.abs(gap).max())})
            if history[-1]["gap"] <= tolerance:
                break
        if history[-1]["gap"] > tolerance:
            _LOG.warning("mixing: no rates reach the targets; a gap of %.5f of all tokens is left", history[-1]["gap"])
    return _rate(pc, k, taken, most), history


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], keep: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``keep``, ``n_tokens``, ``p_<domain>``, ``rate`` and ``gap`` for each row of ``docs``.

    ``targets`` maps domains to shares of all tokens.  ``gap``, alike in all rows,
    is the greatest difference that the rates leave to them, over ``TOLERANCE``
    where no rates reach them, and null where there are no tokens.  Null and
    empty texts have no tokens and get the rate of their prior; repeated rows each
    come back; an empty table gives no rows.
    """
    domains = sorted(targets)
    model = learn_domains(docs, labelled, domains, id_col, text_col)
    slots = tuple(f"__k{i}" for i in range(len(keep)))
    source = docs.select(*(quoted(c).alias(s) for c, s in zip(keep, slots, strict=True)), quoted(text_col).alias("__text"))
    rows = materialize(memberships(source, model, slots, "__text"), "mix-members")
    rate, history = reach_rates(by_posterior(rows), [targets[d] for d in domains])
    gap = F.lit(history[-1]["gap"] if history else None).cast("double")
    return rows.select(*(F.col(s).alias(c) for c, s in zip(keep, slots, strict=True)), "n_tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)), rate.alias("rate"), gap.alias("gap"))


def measured_targets(sums: DataFrame, measured: list[Column], k: int, p: str) -> tuple[list[float], float]:
    """Expected tokens of each domain in documents whose ``measured`` posteriors are 0.5 or more together, and the tokens of all documents."""
    inside = F.when(sum(measured[1:], measured[0]) >= 0.5, F.col("n_tokens")).otherwise(0)
    r = sums.agg(F.sum("n_tokens").alias("total"), *(F.sum(inside * F.col(p)[i]).alias(f"t{i}") for i in range(k))).first()
    return [float(r[f"t{i}"] or 0.0) for i in range(k)], float(r["total"] or 0.0)


def resample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float | None], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each row as often as its rate: the whole part, and once more by a hash of id and length for the fraction.

    A target of None is measured: the expected tokens that the domain has in
    documents which more probably than not are of such domains; the other domains
    then aim at what these same documents hold of them, near zero.  Rates are
    fitted to these targets between 0 and 1, so no row is repeated.  The only ones
    to meet them exactly are 1 for these documents and 0 for others, at any share;
    within the tolerance, documents of about even posteriors get rates between.
    """
    domains = sorted(targets)
    model = learn_domains(docs, labelled, domains, id_col, text_col)
    h = hidden(docs.columns)
    n, b, z, p = (f"{h}{x}" for x in ("n", "b", "z", "p"))
    rows = with_features(docs, text_col, n, b).withColumn(z, model.logits(F.col(b), quoted(text_col))).withColumn(p, softmax(F.col(z), len(domains)))
    rows = materialize(rows.withColumn(p, on_grid(F.col(p))).drop(b, z), "mix-members")
    sums = by_posterior(rows, n, p).withColumnRenamed("p", p)
    measured = [F.col(p)[i] for i, d in enumerate(domains) if targets[d] is None]
    if measured:
        aims, total = measured_targets(sums, measured, len(domains), p)
        rate, _ = reach_rates(sums, aims, p=p, share=sum(aims) / (total or 1.0), most=1.0)
    else:
        rate, _ = reach_rates(sums, [targets[d] for d in domains], p=p)
    unit = F.pmod(F.xxhash64(quoted(id_col), F.length(quoted(text_col).cast("string"))), F.lit(1 << 20)) / float(1 << 20)
    copies = F.floor(rate + unit).cast("int")
    return rows.where(copies > 0).withColumn(f"{h}copy", F.explode(F.sequence(F.lit(1), copies))).select(*(quoted(c) for c in docs.columns))
