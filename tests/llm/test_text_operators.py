"""Token files, language profiles, token counts, byte BPE and quality rules against plain versions."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logweir.llm import byte_bpe, langid, quality, queries, token_counts, token_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, fp string, id string"
LONG = "é".join(f"word{i} " * 3 for i in range(9000))
ROWS = [
    (3, "It's 12 o'clock,\n\n don't <|endoftext|> ÉCOLE naïve\x1cx   y", "en", "a"), (1, None, None, None), (2, "", "fr", "b"), (None, "Plain words here.", "en", "a"),
    (2, "again", "en", "a"), (2, "again", "en", "a"), (9, " \t\n ", "xx", "a"), (7, LONG, "en", "a"), (8, "日本語 テキスト 🙂 é ﬁ ẞ İ Σς", "ja", "c"), (10, "x" * 3000 + " " * 50 + "\n" * 7 + "a" * 9, "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, 5, "clash", "clash") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=1500), st.integers(0, 300))
def test_wavelet_matrix(values, symbol):
    a = np.array(values, dtype=np.uint16)
    m = token_files.WaveletMatrix.build(a, 9)
    assert m.decode().tolist() == values
    places = [i for i, v in enumerate(values) if v == symbol]
    assert m.rank(symbol) == len(places) and m.rank(symbol, len(values) // 2) == sum(i < len(values) // 2 for i in places)
    assert [m.select(symbol, k) for k in range(len(places))] == places and m.select(symbol, len(places)) == -1
    for i in range(0, len(values), 97):
        assert m.access(i) == values[i]
    names, lengths, back = token_files.read_shard(token_files.write_shard([None, 4], [0, len(values)], a, 9) + b"\n")
    assert names == [None, 4] and lengths.tolist() == [0, len(values)] and back.decode().tolist() == values


@pytest.mark.parametrize("file_ids,range_rows", [(1000, 3), (10**9, 10**9)])
def test_token_files(spark, docs, none, file_ids, range_rows):
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want, start = [], 0
    enc = sorted(((i is not None, i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4")) for i, x, *_ in ROWS), key=lambda r: (r[0], r[1] or 0, r[2].astype("<u2").tobytes()))
    for _, i, ids in enc:
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    folder = token_files.write_token_files(docs, path, 1, file_ids=file_ids, range_rows=range_rows)
    got = [tuple(r) for r in token_files.read_token_files(spark, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_files.read_token_files(spark, token_files.write_token_files(none, path, 1)).count() == 0


def test_word_encoder_equals_the_library(sf, spark):
    t = token_files.Encoder(P.path("word_bpe_49k.json"))
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text]
    for x in texts + [r[1] for r in ROWS if r[1]]:
        assert np.frombuffer(t.text(x), t.dtype).tolist() == t.tokenizer.encode(x, add_special_tokens=False).ids


def _tiktoken():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("spread,chunk,overlap", [(65_536, 4096, 256), (20, 64, 16), (10**9, 64, 16)])
def test_byte_bpe(docs, none, spread, chunk, overlap):
    t, want = _tiktoken(), []
    for i, x, *_ in ROWS:
        ids = t.encode_ordinary(x or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()))
    run = lambda d: byte_bpe.encode_texts(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, spread=spread, chunk=chunk, overlap=overlap)
    assert sorted(map(tuple, run(docs).collect()), key=repr) == sorted(want, key=repr)
    assert run(none).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["ab", " ", "  ", "\n", "'s", "12", "é", "a" * 24, "!?", ".", "日本", " "]), max_size=120).map("".join), st.sampled_from([(20, 5), (50, 30), (33, 8)]))
def test_stitched_chunks(text, sizes):
    c = byte_bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    size, overlap = sizes
    parts = byte_bpe.cut(text, size, overlap)
    assert parts[-1][2] and all(text[s : s + len(p)] == p for s, p, _ in parts) and parts[-1][0] + len(parts[-1][1]) == len(text)
    assert byte_bpe.stitch(text, [(s, c.sure(p, last)) for s, p, last in parts], c)[0] == c.pieces(text)


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=400))
def test_merges(piece):
    c = byte_bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert c._merge_long(piece) == tuple(_tiktoken_cached()._encode_single_piece(piece)) == c.merge(piece)


_cache = []


def _tiktoken_cached():
    if not _cache:
        _cache.append(_tiktoken())
    return _cache[0]


def _plain_unigram(scores, longest, unknown, word):
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        found = [(best[s][0] + scores[word[s:end]], best[s][1] - 1) for s in range(max(0, end - longest), end) if word[s:end] in scores]
        if word[end - 1] not in scores:
            n = len(word[end - 1].encode())
            found.append((best[end - 1][0] + n * unknown, best[end - 1][1] - n))
        best[end] = max(found)
    return -best[-1][1], best[-1][0]


def test_token_counts(docs, none):
    path = P.path("piece_bpe_32k.model")
    t = token_counts.UnigramTrie(token_counts.piece_scores(path))
    got = sorted(map(tuple, token_counts.token_counts(docs, path).collect()), key=repr)
    want = []
    for i, x, *_ in ROWS:
        each = [_plain_unigram(t.scores, t.longest, t.unknown, "▁" + w.decode()) for w in (x or "").encode().split()]
        want.append((i, len(each), sum(e[0] for e in each), float(sum(e[1] for e in each))))
    for g, w in zip(got, sorted(want, key=repr), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3])
    assert token_counts.token_counts(none, path).count() == 0
    shared = token_counts.UnigramTrie({"a": -1.0, "ab": -1.5, "b": -1.0})
    assert [shared.insert(w) for w in ("ababb", "abab", "abb", "abab")] == [(3, -4.0), (2, -3.0), (2, -2.5), (2, -3.0)]
    assert shared.computed == 6  # ababb, then abb beyond ab; abab is on the way
    assert sum(map(np.exp, t.scores.values())) == pytest.approx(1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", "é", "日", " ", "aba"]), max_size=12).map("".join), min_size=1, max_size=12), st.sampled_from([5, 10**6]))
def test_token_counts_in_any_order_and_with_any_bound(texts, nodes):
    """Several slices share one trie, which may begin anew at any place."""
    scores = token_counts.rank_scores(["▁", "a", "ab", "▁a", "b", "ba"])
    t = token_counts.UnigramTrie(scores, nodes=nodes)
    for x, (n, tokens, score) in zip(texts * 2, t.count(texts) + t.count(texts), strict=True):
        each = [_plain_unigram(t.scores, t.longest, t.unknown, "▁" + w) for w in x.split()]
        assert (n, tokens) == (len(each), sum(e[0] for e in each)) and score == pytest.approx(sum(e[1] for e in each))


def _plain_grams(text):
    words, now = [], ""
    for ch in (text or "").lower():
        if ch.isalpha():
            now += ch
        elif now:
            words.append(now)
            now = ""
    words += [now] if now else []
    out = Counter()
    for w in words:
        out.update(w)
        p = f"\1{w}\1"
        out.update(p[i : i + 2] for i in range(len(p) - 1))
        out.update(p[i : i + 3] for i in range(len(p) - 2))
    return out


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aAbß éİ1.\n日", max_size=60))
def test_grams(text):
    pack = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    codes, n = langid.grams(text)
    assert dict(zip(codes.tolist(), n.tolist(), strict=True)) == {pack(g): k for g, k in _plain_grams(text).items()}


def test_language_id(spark, sf, docs, none):
    all_ = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op3_language_id(spark, sf)
    rows = got.join(all_.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    p = langid.learn(all_.select(F.col("doc_id").alias("id"), "text", "lang"))
    by = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, p).collect()}
    assert by[1] == by[9] == ("und", 0.0) and by[7][0] in p.langs and all(0 <= s <= 1 for _, s in by.values())
    assert langid.identify(none, p).count() == 0
    empty = langid.learn(none.select(F.col("doc_id").alias("id"), "text", "lang"))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


def test_out_of_place_distance():
    p = langid.Profiles({"x": [10, 20, 30], "y": [30, 20, 10]}, size=3)
    mine = langid.ranking("abab", 3).tolist()
    q = langid.Profiles({"same": mine, "turned": mine[::-1]}, size=3)
    assert q.predict("abab") == ("same", 1.0) and p.predict("abab")[1] == 0.0


def _plain_counts(text):
    text = text or ""
    words = [w for w in text.translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip("\t\n\x0b\x0c\r "):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", "\n", "\x0b", " ", "#", "é", "a b a b a", "\n\n"]), max_size=60).map("".join))
def test_quality_counts(text):
    assert quality.counts(text) == _plain_counts(text)


def test_quality_rules(spark, sf, docs, none):
    out = quality.judge(docs, tuple(docs.columns), prefix="new_")
    assert out.count() == len(ROWS) and set(docs.columns) <= set(out.columns)
    by = {r.doc_id: r for r in quality.judge(docs, ("doc_id",)).collect()}
    assert by[1].base_failed and not by[1].kept and by[10].base_failed and by[7].kept
    assert quality.judge(none, ("doc_id",)).count() == 0
    lab = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op9_quality_rules(spark, "/root/testdata/sf0.01").collect()
    lab = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    good = [r for r in rows if lab.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r for r in rows if lab.get(r.doc_id) == 0]
    assert all(r.kept for r in good) and sum(not r.kept for r in bad) >= 0.9 * len(bad)


def _plain_marks(text):
    text = text or ""
    words = [w for w in text.translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if w]
    pieces = [words[i : i + 10] for i in range(0, len(words) - 9, 10)]
    ascii_ = [c for c in text if c < "\x7f"]
    return sum(33 <= ord(c) and not c.isalnum() for c in ascii_), sum(c.isalpha() for c in ascii_), sum(c in "aeiouyAEIOUY" for c in ascii_), sum(len(set(p)) for p in pieces), 10 * len(pieces), text.count("\n") + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b1", " ", "\n", "\x7f", "#", "é", "a b a B a", "."]), max_size=60).map("".join))
def test_quality_marks(text):
    assert quality.marks(text) == _plain_marks(text)


def _plain_mcd(x, w, scale):
    """The minimum covariance determinant of one group in plain NumPy: location, scatter and rows."""
    n, p = x.shape
    ridge, mid = quality.RIDGE * np.diag(np.square(scale)), np.quantile(x, 0.5, axis=0, method="inverted_cdf")
    off = (x - mid) * np.sqrt(w)[:, None]
    s = np.sqrt((1.4826 * np.quantile(np.abs(off), 0.5, axis=0, method="inverted_cdf")) ** 2 + np.diag(ridge))
    z = off / s
    u = z / np.sqrt(np.maximum((z * z).sum(axis=1), 1e-12))[:, None]
    factor = quality.SUBSET / quality.chi2_share(quality.chi2_quantile(quality.SUBSET, p), p + 2)

    def step(loc, c):
        d = w * np.einsum("ni,ij,nj->n", x - loc, np.linalg.inv(c), x - loc)
        near = d <= np.quantile(d, quality.SUBSET, method="inverted_cdf")
        loc = (w[near, None] * x[near]).sum(axis=0) / w[near].sum()
        y = (x[near] - loc) * np.sqrt(w[near])[:, None]
        return loc, factor * y.T @ y / near.sum() + ridge

    ends = []
    for c in (np.eye(p), np.tanh(z).T @ np.tanh(z) / n, u.T @ u / n * p):
        fit = mid, c * np.outer(s, s) + ridge
        for _ in range(quality.STEPS):
            fit = step(*fit)
        ends.append((np.linalg.slogdet(fit[1])[1], fit))
    fit = min(ends, key=lambda e: e[0])[1]
    for _ in range(quality.MORE_STEPS):
        fit = step(*fit)
    return *fit, n


def _plain_verdicts(docs, scatter=None):
    """Distances by the plain estimate, or by one constant scatter."""
    got = {i: (np.array([_plain_counts(t)]), np.array([_plain_marks(t)])) for i, (t, _, _) in docs.items()}
    rows = {i: quality.vectors(*v)[0] for i, v in got.items() if v[0][0, 0] >= 10 and 100 * v[0][0, 4] <= 20 * v[0][0, 0]}
    scale = np.maximum(np.stack([r[1:] for r in rows.values()]).std(axis=0), 1e-6)
    groups = {}
    for i, v in rows.items():
        for g in ((docs[i][1], docs[i][2]), (docs[i][1],), ()):
            groups.setdefault(g, []).append(v)
    fits = {g: _plain_mcd(np.stack(v)[:, 1:], np.stack(v)[:, 0], scale) for g, v in groups.items()}
    lean = lambda a, b: tuple((a[2] * x + quality.PRIOR * y) / (a[2] + quality.PRIOR) for x, y in zip(a[:2], b[:2], strict=True))
    out = {}
    for i, v in rows.items():
        _, lang, source = docs[i]
        loc, c = lean(fits[lang, source], lean(fits[lang,], fits[()]))
        d = v[1:] - loc
        out[i] = v[0] * d @ np.linalg.inv(c if scatter is None else scatter) @ d
    return out, scale


def test_chi_square():
    assert quality.chi2_share(2 * np.log(2), 2) == pytest.approx(0.5) and quality.chi2_quantile(0.95, 1) == pytest.approx(3.841, abs=1e-3)


def test_verdicts_come_from_the_estimates(spark):
    """Distances agree with a plain NumPy estimate; a constant scatter in its place gives other verdicts."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: (r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op9_quality_rules(spark, sf).collect()}
    far, scale = _plain_verdicts(docs)
    limit = quality.chi2_quantile(1 - quality.CHANCE, len(quality.FEATURES))
    assert all(got[i].kept == (i in far and far[i] <= limit) for i in docs)
    gap = np.array([abs(got[i].distance - d) / (d + 0.1) for i, d in far.items()])  # quantiles of the query are exact to a thousandth
    assert np.median(gap) < 0.01 and gap.max() < 0.1, (np.median(gap), gap.max())
    flat, _ = _plain_verdicts(docs, np.diag(np.square(scale)))
    assert sum((d <= limit) != (far[i] <= limit) for i, d in flat.items()) > 20


def test_a_group_of_its_own_has_its_own_estimate(spark):
    """A source whose texts would be outliers among others keeps them, once it has many."""
    rng = np.random.default_rng(3)
    text = lambda word: " ".join("".join(rng.choice(list("aeiounrstl"), max(1, int(rng.normal(word, 1))))) + "." * (rng.random() < 0.1) for _ in range(120))
    rows = [(i, text(5), "en", "a", 0) for i in range(400)] + [(1000 + i, text(12), "en", "b", 0) for i in range(400)] + [(2000, text(12), "en", "c", 0), (2001, text(12), None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, distance int")
    by = {r.doc_id: r for r in quality.judge(df, ("doc_id",)).collect()}
    assert sum(not by[i].kept for i in range(400)) + sum(not by[1000 + i].kept for i in range(400)) < 8
    alone = {r.doc_id: r for r in quality.judge(df.where("source <> 'b'"), ("doc_id",)).collect()}
    assert not alone[2000].kept


def test_estimate_resists_outliers(spark):
    rng = np.random.default_rng(1)
    clean, bad = rng.normal([1, 0, 0, 0], 0.1, (400, 4)), rng.normal([5, 2, 1, 1], 0.1, (100, 4))
    rows = [("g", 1.0, *map(float, v)) for v in (*clean, *bad)] + [("tiny", 1.0, 1.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, w double, a double, b double, c double, d double")
    fit = {r.g: r for r in quality.determinant_fits(df, list("abcd"), "w", [1.0] * 4).collect()}
    assert np.allclose(fit["g"]["loc"], [1, 0, 0, 0], atol=0.05) and np.allclose(fit["tiny"]["loc"], [1, 0, 0, 0])
    assert np.allclose(np.diag(np.array(fit["g"]["cov"]).reshape(4, 4)), 0.01 + quality.RIDGE, atol=0.01)
