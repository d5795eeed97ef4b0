"""SimHash groups, embeddings, components, near-duplicate removal and the archive against plain versions."""

import gzip
import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweir.llm import components, embeddings, near_dedup, queries, simhash, warc


def _roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components(spark, links):
    df = spark.createDataFrame([*links, (3, None)], "u long, v long")
    nodes = {n for a, b in links if a != b for n in (a, b)}
    got = {r.node: r.root for r in components.connected_components(df).collect()}
    assert got == _roots(nodes, [x for x in links if x[0] != x[1]])


def _plain_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "É", " ", "\n", " ", "c d e"]), max_size=40).map("".join))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == _plain_fingerprint(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**12 - 1), max_size=60), st.integers(0, 4))
def test_bk_tree(values, radius):
    links = simhash.forest(values, radius)
    nodes = set(values)
    want = _roots(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= radius])
    assert _roots(nodes, links) == want and len(links) == len(nodes) - len(set(want.values()))


def _near(rng, fp, bits):
    for i in rng.sample(range(64), bits):
        fp ^= 1 << i
    return fp


@pytest.mark.parametrize("shard_rows", [2, 1000])
def test_links_of_fingerprints(spark, shard_rows):
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(80)} | {0, 2**64 - 1}
    for v in list(values)[:40]:
        values |= {_near(rng, v, b) for b in (1, 2, 3, 4)}
    v = next(iter(values))
    for _ in range(30):  # a crowd that shares most blocks
        values.add(v := _near(rng, v, 2))
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    links = [(r.u & simhash.ALL, r.v & simhash.ALL) for r in simhash.fingerprint_links(df, 3, shard_rows).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    assert _roots(values, links) == _roots(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3])


def test_simhash_query(spark, sf):
    rows = queries.op2_simhash(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fp = {i: _plain_fingerprint(t) for i, t in docs.items()}
    want = _roots(set(docs), [(a, b) for a in docs for b in docs if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{fp[i]:016x}", want[i]) for i in docs}


def test_simhash_edge_rows(spark):
    kind = "doc_id long, text string, fp string, component_id string"
    df = spark.createDataFrame([(5, None, "x", "y"), (4, "", "x", "y"), (None, " \n", "x", "y"), (4, "a b c d", "x", "y"), (4, "a b c d", "x", "y"), (None, "z q", "x", "y")], kind)
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=repr)
    zero, abcd, zq = "0" * 16, f"{_plain_fingerprint('a b c d'):016x}", f"{_plain_fingerprint('z q'):016x}"
    assert got == sorted([(5, zero, 4), (4, zero, 4), (None, zero, 4), (4, abcd, 4), (4, abcd, 4), (None, zq, None)], key=repr)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def _text(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_near_dedup(spark):
    rng = random.Random(3)
    kind = "doc_id long, text string, lang string, source string, n_chars long, k string, __x int"
    texts, groups = [], []
    for i in range(40):
        base = _text(rng, 200)
        texts.append((2 * i, " ".join(base)))
        if i % 2:
            near = list(base)
            near[60 + i] = "changed"
            texts.append((2 * i + 1, " ".join(near)))
            groups.append({2 * i, 2 * i + 1})
    texts += [(900, texts[0][1]), (900, texts[0][1]), (901, texts[0][1].upper()), (None, texts[4][1]), (None, None), (902, ""), (903, "one two")]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "k", 1) for i, t in texts], kind)
    for rows, tiles in ((3, 2), (3, 100), (1000, 8)):
        out = near_dedup.near_dedup(df, shard_rows=rows, most_tiles=tiles)
        ids = sorted(r.doc_id for r in out.collect())
        assert out.columns == df.columns and ids == sorted([*(2 * i for i in range(40)), 902, 903])
    twice = spark.createDataFrame([(1, "a b c", "en", "s", 0, "k", 1)] * 3, kind)
    assert near_dedup.near_dedup(twice).count() == 1 and near_dedup.near_dedup(df.limit(0)).count() == 0


    clash = df.where("doc_id < 4").select("doc_id", "text", *(F.lit(1).alias(c) for c in ("__fp", "__name", "__mins", "__hfp", "__H_n", "a.b", "k", "fp", "name")))
    out = near_dedup.near_dedup(clash)
    assert out.columns == clash.columns and sorted(r[0] for r in out.collect()) == [0, 2]
    long = " ".join(_text(rng, 120_000))
    assert [r.doc_id for r in near_dedup.near_dedup(spark.createDataFrame([(2, long + " x"), (1, long)], "doc_id long, text string")).collect()] == [1]


def _text_rows_shuffled(spark, df):
    """Rows with a text that joins of the plan get by an exchange, as run."""
    df.collect()
    plan, texts = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        elif kind == "ShuffleExchangeExec" and any(p.output().apply(i).name() == "c1" for i in range(p.output().size())):
            texts = max(texts, p.metrics().apply("shuffleRecordsWritten").value())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return texts


def test_near_dedup_shuffles_only_texts_in_question(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(_text(rng, 30))) for i in range(2000)]
    rows += [(10_000 + i, rows[i][1]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where tables are large
    try:
        out = near_dedup.near_dedup(df)
        assert sorted(r.doc_id for r in out.collect()) == list(range(2000))
        assert 20 <= _text_rows_shuffled(spark, out) <= 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("words", [1, 64])
def test_a_full_bloom_filter_loses_nothing(spark, monkeypatch, words):
    monkeypatch.setattr(near_dedup, "WORDS", words)
    rows = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("name"), "id")
    bits = near_dedup.bloom(rows.where("id % 7 = 0").select("name"), "test-bits")
    inside, outside = near_dedup.sifted(rows, ["name"], bits)
    got, rest = ({r.id for r in df.collect()} for df in (inside, outside))
    assert set(range(0, 5000, 7)) <= got and not got & rest and got | rest == set(range(5000)) and bits.count() <= words
    texts = [(i, t) for i, t in enumerate(["a b c d e f", "A b c d e f", "x y", "x y", "z", None, "", "q r s"])]
    df = spark.createDataFrame([*texts, (None, "z"), (2, "x y")], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup.near_dedup(df).collect()) == [0, 2, 4, 5, 7]


def test_radius_grows_as_similarity_falls():
    assert near_dedup.radius(1.0) == 0 < near_dedup.radius(0.9) < near_dedup.radius(0.8) < near_dedup.BITS // 4


def _plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def _plain_groups(sets):
    """Groups of an exact join at similarity 0.8, through an index of all shingles."""
    index = {}
    for i, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(i)
    links = []
    for i, s in sets.items():
        shared = {}
        for g in s:
            for j in index[g]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        links += [(i, j) for j, n in shared.items() if n >= 0.8 * (len(s) + len(sets[j]) - n)]
    empty = [i for i, s in sets.items() if not s]
    return links + list(zip(empty, empty[1:], strict=False))


@pytest.mark.parametrize("shard_rows,tiles", [(1024, 8), (4, 2)])
def test_near_dedup_against_an_exact_join(spark, shard_rows, tiles):
    """On the tables, and on texts with similarities near 0.8 that share a passage: small shards and forced large ones."""
    rng = random.Random(5)
    passage, rows = _text(rng, 12), [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for i in range(60):
        base = passage + _text(rng, 100)
        rows.append((10**6 + 10 * i, " ".join(base)))
        for c in range(1, 4):
            near = list(base)
            for at in rng.sample(range(12, 108), rng.randrange(1, 4)):
                near[at] = f"c{c}x{at}"
            rows.append((10**6 + 10 * i + c, " ".join(near)))
    links = _plain_groups({i: _plain_shingles(t) for i, t in rows})
    want = _roots({i for i, _ in rows}, links)
    got = {r.doc_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shard_rows=shard_rows, most_tiles=tiles).select("doc_id").collect()}
    kept = set(want.values())
    gone = {i for i, _ in rows} - kept
    assert kept <= got  # nothing goes that is no near duplicate
    assert len(got - kept) <= 0.01 * len(gone), (len(got - kept), len(gone))


def _plain_links(rows, cosine=0.98):
    ok = []
    for n, (_, e, label) in enumerate(rows):
        good = e is not None and label is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)
        ok.append(np.array(e, dtype=float) / np.linalg.norm(np.array(e, dtype=float)) if good else None)
    return [(a, b) for a in range(len(rows)) for b in range(a) if ok[a] is not None and ok[b] is not None and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine]


@pytest.mark.parametrize("lists,tile,slices", [(None, 2048, 16384), (6, 5, 7)])
def test_embeddings(spark, lists, tile, slices):
    rng = np.random.default_rng(2)
    rows = []
    for label in (0, 1):
        for _ in range(40):
            v = rng.normal(size=16).astype(np.float32)
            rows.append((len(rows), v.tolist(), label))
            for s in (0.02, 0.04, 0.06)[: rng.integers(0, 4)]:
                rows.append((len(rows), (v + s * rng.normal(size=16)).astype(np.float32).tolist(), int(rng.integers(0, 2))))
    hot = rows[0][1]
    rows += [(len(rows) + i, hot, 0) for i in range(12)] + [(500, [2 * x for x in hot], 0), (501, None, 0), (502, [0.0] * 16, 0), (503, [float("nan")] * 16, 0), (504, [None] + [1.0] * 15, 0), (505, hot, None), (506, [], 0), (507, [1.0, 2.0], 0), (508, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "vec_id long, embedding array<float>, label int, class string, list string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, lists=lists, tile=tile, query_tile=slices).collect()}
    links = _plain_links([(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], k) for i, e, k in rows])
    roots = _roots(set(range(len(rows))), links)
    for n, (i, _, _) in enumerate(rows):
        root = min(rows[m][0] for m in range(len(rows)) if roots[m] == roots[n])
        assert got[i] == (sum(n in x for x in links), root, i == root), i
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("lists", [1, 2, 5, 8])
def test_embeddings_of_mixed_precision(spark, lists):
    """Vectors that floats hold, vectors that need doubles, and huge and tiny ones; lists even and odd in number."""
    rng = np.random.default_rng(5)
    rows = []
    for n in range(30):
        v = rng.normal(size=12)
        for scale in (1.0, 1e200, 1e-200)[: 1 + n % 3]:
            rows.append((len(rows), (scale * (v + 0.03 * rng.normal(size=12))).tolist(), 0))
        rows.append((len(rows), v.astype(np.float32).astype(float).tolist(), 0))
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), lists=lists, tile=4, query_tile=5).collect()}
    links = _plain_links([(i, (np.array(e) / np.abs(e).max()).tolist(), k) for i, e, k in rows])
    assert links and got == {n: sum(n in x for x in links) for n in range(len(rows))}


def test_embedding_recall_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = {r[0]: 0 for r in rows}
    for a, b in _plain_links(rows):
        want[rows[a][0]] += 1
        want[rows[b][0]] += 1
    assert {r.vec_id: r.n_links for r in queries.op7_embeddings(spark, sf).collect()} == want


PAGES = "page_id long, url string, html string, sha256 string, copies int"


def test_archive(spark):
    big, small = "ä" * 700 + "\r\n\r\nWARC/1.1\r\n\r\n", "tiny\r\n"
    rows = [(1, "http://a", big), (5, "http://b\r\nX: y", big), (3, None, big), (2, "u", small), (4, "u", small), (6, "u", None), (7, "u", ""), (None, "u", big), (9, "z", "q" * 1000), (9, "z", "q" * 1000), (8, "z", "q" * 999)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES)
    folder = warc.write_archive(df)
    got = warc.read_archive(spark, folder).collect()
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        top = {big: 5, "q" * 1000: 9}.get(h)
        kind = "response" if top is None or i == top else "revisit"
        want.append([i, len(body), hashlib.sha1(body).hexdigest(), kind, None if kind == "response" else top, body])
    want[9][3:5] = ["revisit", 9]  # of the two equal rows one is the response
    key = lambda r: repr(r)
    assert sorted([[r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)] for r in got], key=key) == sorted(want, key=key)
    assert warc.read_payloads(spark, folder).count() == len({h or "" for _, _, h in rows})
    assert all(r.header.startswith("WARC/1.1\r\nWARC-Type: ") and "\r\nX: y" not in r.header for r in got)
    empty = warc.write_archive(df.limit(0))
    assert warc.read_archive(spark, empty).count() == 0


def test_a_changed_payload_is_noticed():
    record = warc.payload_record(hashlib.sha256(b"abc").hexdigest(), hashlib.sha1(b"abc").hexdigest(), b"abc")
    blob = gzip.compress(record) + gzip.compress(record)
    assert [warc.parse_record(m)[1] for m in warc.members(blob + b"\n")] == [b"abc", b"abc"]
    with pytest.raises(ValueError):
        warc.parse_record(record[:-1])
    with pytest.raises(ValueError):
        list(warc.members(blob[:-3]))


def test_archive_query_matches_plain(spark, sf):
    got = queries.op10_warc(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert got.where(F.col("record_type") == "revisit").where(F.col("refers_to").isNull()).count() == 0
