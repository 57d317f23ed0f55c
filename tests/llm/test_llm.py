"""Small fixtures against brute force, round trips and held-out accuracy; nulls, empty and long texts, ties, repeated rows."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import SF, same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gleaner.llm import bpe, common, covertree, forest, language, lm, packing, queries, setsketch, substring, urlrules, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, kept string"
g = random.Random(4)
WORDS = [f"w{i}" for i in range(60)]
LONG = " ".join(g.choices(WORDS, k=300))


def text(n):
    return " ".join(g.choices(WORDS, k=n))


BASE = text(120)
TEXTS = [None, "", "  ", "One", "two Words", "é É ΟΔΟΣ I'll <|endoftext|> x", BASE, BASE, BASE + " more", "x " + BASE, text(40) + " " + BASE[:200] + " " + text(40), LONG, LONG.replace("w1 ", "w2 ", 2), "a" * 3000, "a  b\n\n c ", *(text(g.randrange(1, 60)) for _ in range(20))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 4 == 0 else "xx", "s", None, "clash", "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def table(df, key):
    return {r[key]: r for r in df.collect()}


def test_op1(docs, empty):
    t = Tokenizer.from_file(path := public_tokenizers.path("word_bpe_49k.json"))
    got = table(bpe.encode(docs, path), "doc_id")
    dig = table(bpe.encode_digests(docs, path, size=5), "doc_id")
    for i, x in enumerate(TEXTS):
        ids = t.encode(x or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert bytes(got[i].ids) == raw and got[i].decoded == t.decode(ids, skip_special_tokens=False)
        assert (dig[i].n_tokens, dig[i].ids_sha256) == (len(ids), hashlib.sha256(raw).hexdigest())
    assert bpe.encode_digests(empty, path).count() == 0


@pytest.mark.parametrize(("counts", "size"), [([1_000_000 + i for i in range(3000)], 10), ([5] * 5000, 1234), ([3_000_000_000] * 20, 10), ([7] * 5000 + [2**40 + i for i in range(4)], 1004), ([], 3), (list(range(1, 5000)), 1500), ([2**55 + i * 2**40 for i in range(2500)], 7)])
def test_most_frequent_is_exact(spark, counts, size):
    rows = [(b"%d" % i, n) for i, n in enumerate(counts)]
    got = common.most_frequent(common.settle(spark.createDataFrame(rows, "word binary, n long")), size)
    want = sorted(counts, reverse=True)[:size]
    assert [r.n for r in got] == want and len({bytes(r.word) for r in got}) == len(want)


def test_looked_up(spark):
    """Hot keys, others, keys that aren't there and null: each row gets its value, and stays as often as it stands."""
    keys = ["hot"] * 300 + [f"k{i % 40}" for i in range(200)] + ["unknown"] * 5 + [None] * 90
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, i int")
    known = common.settle(spark.createDataFrame([("hot", 7, 300)] + [(f"k{i}", i, 5) for i in range(40)], "key string, value int, n int"), 41)
    want = {i: None if k in (None, "unknown") else 7 if k == "hot" else int(k[1:]) for i, k in enumerate(keys)}
    for share in (1, 2, 1000):
        got = common.looked_up(rows, "key", known, "value", "n", share).collect()
        assert len(got) == len(keys) and {r.i: r.value for r in got} == want


def test_op1_characters_that_tables_do_not_agree_on(spark):
    """Each assigned block's edges and every unassigned character, by the library."""
    t = Tokenizer.from_file(path := public_tokenizers.path("word_bpe_49k.json"))
    e = bpe.Encoder(bpe.Vocabulary(path))
    for c in range(0x80, 0x32000, 7):
        if not 0xD800 <= c < 0xE000:
            x = f"a{chr(c)}1 {chr(c)}! b"
            ids = t.encode(x, add_special_tokens=False).ids
            assert e(x) == (np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False).encode())


def test_op1_lexicon_and_merges():
    v = bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    words = {w.encode() for w in ["the", "then", "them", "theme", "in", "ing", "sing", "being", "b"]}
    lexicon = bpe.Lexicon(bpe.build_lexicon({w: tuple(v.merge(w)) for w in words}))
    assert all(lexicon.get(w) == v.merge(w) for w in words)
    assert all(lexicon.get(w) is None for w in (b"th", b"", b"thenx", b"x"))
    fast = v.ranked()
    for _ in range(300):
        w = "".join(g.choices("abcdeinorstüß", k=g.randrange(1, 70))).encode()
        assert fast(w) == v.merge(w) == v._merge_long([v.inner[b] for b in w[:-1]] + [v.last[w[-1]]])


def test_op2(spark, docs, empty):
    d = common.table(spark, SF, "documents")
    got = language.predict(d, language.train(language.training_rows(d)), keep=("lang",)).where(language.fold() == 0).toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.95 and got["score"].between(0, 1).all()
    r = table(language.predict(docs, language.train(docs)), "doc_id")
    assert r[0].lang_pred == r[1].lang_pred == r[2].lang_pred == "und" and r[3].lang_pred == "xx"
    assert language.predict(empty, language.train(empty)).count() == 0
    assert {r.lang_pred for r in language.predict(docs, language.train(empty)).collect()} == {"und"}


def test_op2_slices_and_null_ids(spark, monkeypatch):
    x = "Ein Satz, ΟΔΟΣ und  noch -- einer; 12 Wörter " * 40
    whole = language.trigram_counts(x)
    for size in (1, 2, 3, 7, 100):
        monkeypatch.setattr(language, "SLICE", size)
        assert (language.trigram_counts(x) == whole).all() and language.trigram_counts("12 -- " * 9) is None
    df = spark.createDataFrame([(None, "Text eins", "aa"), (5, "text two", "bb"), (None, None, None)], "doc_id long, text string, lang string")
    assert language.training_rows(df).count() == 1
    got = language.predict(df, language.train(df)).withColumn("held_out", language.fold() == 0).collect()
    assert sorted((r.lang_pred, r.held_out) for r in got if r.doc_id is None) == [("aa", None), ("und", None)]


def test_op2_mixture():
    p = np.zeros((3, language.CELLS)) + 1e-9
    for i in range(3):
        p[i, i * 100 : i * 100 + 100] = 0.01
    n = np.zeros(language.CELLS)
    n[:100], n[100:200] = 3, 1
    assert np.allclose(language.infer(n, p / p.sum(1, keepdims=True)), [0.75, 0.25, 0], atol=0.01)


def test_op3(spark):
    big = "ü" * 9000
    pages = [(3, "http://a/", big), (1, "http://b/", big), (2, None, None), (5, "u", ""), (4, "u\r\nx", "p"), (4, "u\r\nx", "p"), (None, "n", "null id"), (7, "h", "x" * 40_000)]
    got = sorted((tuple(r) for r in warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()), key=str)
    first = {}
    for i, _, h in pages:
        first[h or ""] = min(first.get(h or "", 99), 99 if i is None else i)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        same_ = first[h or ""] == (99 if i is None else i)
        want.append((i, len(raw), warc.digest_of(raw), "response" if same_ else "revisit", None if same_ else first[h or ""]))
    assert got == sorted(want, key=str)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_op3_hot_payload(spark):
    """A payload of a third of all pages is found in the broadcast, others by the join."""
    pages = [(i, f"u{i}", "hot" if i % 3 == 0 else f"p{i // 8}") for i in range(600)] + [(None, "n", "hot"), (5, "u5", "p0")]
    first = {}
    for i, _, h in pages:
        first[h] = min(first.get(h, 10**9), 10**9 if i is None else i)
    for share in (2, 10, 1000):
        got = warc.with_types(spark.createDataFrame(pages, "page_id long, url string, html string"), hot_share=share).collect()
        assert {(r.page_id, r.url): (bytes(r.payload).decode(), r.refers_key) for r in got} == {(i, u): (h, first[h] if first[h] != i else None) for i, u, h in pages}
        assert len(got) == len(pages)


def test_op3_members_at_any_window():
    parts = [bytes([i]) * (i * 37) for i in range(40)]
    import gzip

    data = b"".join(gzip.compress(p) for p in parts)
    for window in (1, 7, 64, 1 << 15):
        assert list(warc.members(data, window)) == parts
    with pytest.raises(ValueError, match="ends early"):
        list(warc.members(data[:-3]))


def test_op3_damage(spark):
    rec = lambda n, total, block: (1, "response" if n == 1 else "continuation", "o", n, total, block, None, None)
    df = spark.createDataFrame([rec(1, None, b"ab"), rec(3, 4, b"cd")], warc.RECORDS)
    with pytest.raises(Exception, match="segments are missing"):
        warc.reassemble(df).collect()
    assert warc.unchunked(warc.chunked(b"x" * 10_000)) == b"x" * 10_000


def vectors(n=260, dims=8, seed=2):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dims)).astype(np.float32)
    x[n // 2 :] = x[: n - n // 2] + r.normal(size=(n - n // 2, dims)).astype(np.float32) * 0.2
    rows = [(i, x[i].tolist(), i % (n // 2) % 3) for i in range(n)]
    rows[5] = (5, rows[4][1], rows[4][2])
    return rows + [(1000, None, 1), (1001, [0.0] * dims, 1), (1002, [float("nan")] + [1.0] * (dims - 1), 1), (1003, [None] + [1.0] * (dims - 1), 1), (1004, rows[0][1], None)]


VECTORS = "vec_id long, embedding array<float>, label int"


def test_op4(spark):
    rows = vectors()
    got = forest.search(spark.createDataFrame(rows, VECTORS), every=10, k=5, leaf=16, probes=0.6).toPandas()
    fine = [(i, np.array(v, float)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    hits = 0
    for q, x in fine:
        if q % 10 == 0:
            near = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in fine if i != q)[:5]
            own = got[got["query_id"] == q].sort_values("rank")
            assert own["rank"].tolist() == [1, 2, 3, 4, 5]
            hits += len(set(own["vec_id"]) & {i for _, i in near})
            for i, s in zip(own["vec_id"], own["score"], strict=True):
                assert abs(s - np.sqrt(((dict(fine)[i] - x) ** 2).sum())) < 1e-12
    assert hits / (5 * got["query_id"].nunique()) >= 0.9
    assert forest.search(spark.createDataFrame([], VECTORS)).count() == 0


def test_op4_recall_with_production_parameters(spark):
    x = np.random.default_rng(2000).normal(size=(2000, 64))
    got = forest.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), every=20).toPandas()
    hits = 0
    for q in range(0, 2000, 20):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(got["vec_id"][got["query_id"] == q]) & set(np.argsort(d)[:10].tolist()))
    assert hits / 1000 >= 0.9


@pytest.mark.parametrize("n", [1, 2, 10])
def test_op4_few_vectors(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 4))
    got = forest.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), every=1).collect()
    near = lambda q: sorted((i for i in range(n) if i != q), key=lambda i: ((x[i] - x[q]) ** 2).sum())
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(q, rank, i) for q in range(n) for rank, i in enumerate(near(q), 1)]


def test_op5(spark, monkeypatch):
    monkeypatch.setattr(covertree, "CELL", 40)
    monkeypatch.setattr(covertree, "LEAF", 4)
    monkeypatch.setattr(covertree, "SPREAD", 1)
    rows = vectors()
    got = table(covertree.components_of(spark.createDataFrame(rows, VECTORS)), "vec_id")
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: lab for i, _, lab in rows}
    near = {i: [j for j in unit if j != i and label[i] == label[j] and unit[i] @ unit[j] >= 0.93] for i in unit}
    low = {i: i for i in label}
    for _ in range(50):
        low = {i: min([low[i], *(low[j] for j in near.get(i, []))]) for i in low}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (len(near.get(i, [])), low[i], low[i] == i) for i in low}
    assert sum(map(len, near.values())) > 50
    assert covertree.components_of(spark.createDataFrame([], VECTORS)).count() == 0


def brute_substring(texts, width=20):
    seen, out = set(), []
    for x in texts:
        words = common.words_of(x)
        gone = set()
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            if w in seen:
                gone.update(range(i, i + width))
            seen.add(w)
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def test_op6(docs, empty, monkeypatch):
    want = brute_substring(TEXTS)
    for share in (500, 1 << 20):  # repeats are found within a share, and between shares
        monkeypatch.setattr(substring, "SHARE_BYTES", share)
        got = table(substring.dedup_digests(docs), "doc_id")
        assert [(got[i].n_words, got[i].n_removed, got[i].kept_sha256) for i in range(len(TEXTS))] == want
    assert sum(w[1] for w in want) > 200
    for hot in (1, 3_000):  # buckets beyond the limit go on: some, or all of them down to single windows
        assert table(substring.dedup_digests(docs, hot_bytes=hot), "doc_id") == got
    cut = table(substring.dedup(docs), "doc_id")
    assert cut[7].text == "" and cut[6].text == BASE and cut[0].text is None and cut[2].text == "  "
    assert substring.dedup_digests(empty).count() == 0
    twice = substring.dedup_digests(docs.union(docs)).where("doc_id = 6").collect()
    assert [r.n_removed for r in twice] == [0, 0]


def test_op6_slices(monkeypatch):
    """Slices hold each window once, whatever their size; texts are put together again."""
    r = random.Random(3)
    x = " \t".join(r.choices([*WORDS, "long" * 20], k=400))
    words = common.words_of(x)
    for most in (1, 30, 200, 5000):
        got = list(substring.slices(x, most, 4))
        assert [tuple(w[i : i + 5]) for _, w, _ in got for i in range(len(w) - 4)] == [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        assert all(words[b : b + len(w)] == w for b, w, _ in got)
        monkeypatch.setattr(substring, "SHARE_BYTES", most)
        kept = [k for _, ks in substring.kept_of(x, [(3, 9), (100, 130)], 5) for k in ks]
        assert kept == words[:3] + words[13:100] + words[134:]


def test_op6_and_pipeline_ids_shared_by_different_texts(spark):
    """Null ids and a repeated id: each row is judged by its own text."""
    r = random.Random(19)
    a, b, c = (" ".join(r.choices([f"u{i}" for i in range(500)], k=80)) for _ in range(3))
    rows = [(1, a), (3, b + " tail"), (3, c), (None, a + " x"), (None, "y " + c), (None, "z"), (2, b), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # ids in order: a, b, then (3, b tail), (3, c) in either order, then nulls
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring.dedup_digests(df).collect())
    assert got == sorted([(1, 80, 0), (2, 80, 0), (3, 81, 80), (3, 80, 0), (0, 81, 80), (0, 81, 80), (0, 1, 0), (0, 0, 0)])
    texts = sorted((r.doc_id or 0, r.text or "") for r in substring.dedup(df).collect())
    assert texts == sorted([(1, a), (2, b), (3, "tail"), (3, c), (0, "x"), (0, "y"), (0, "z"), (0, "")])


def test_op5_ids_shared_by_different_vectors(spark):
    rows = [(7, [1.0, 0.0], 1), (7, [0.0, 1.0], 1), (None, [0.6, 0.8], 1), (None, [-1.0, 0.0], 1), (None, [-1.0, 0.01], 1), (3, [0.0, 2.0], 1), (3, [0.0, 2.0], 1), (1, [1.0, 0.0], 2)]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in covertree.components_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == sorted([(7, 0, 7, True), (7, 2, 3, False), (0, 0, 0, True), (0, 1, 0, True), (0, 1, 0, True), (3, 2, 3, True), (3, 2, 3, True), (1, 0, 1, True)])


def test_op5_dense_group(spark):
    """A ball of vectors that all link, and one place with many rows."""
    r = np.random.default_rng(3)
    x = np.concatenate([np.ones((600, 6)) + r.normal(size=(600, 6)) * 0.02, -np.ones((40, 6)) * r.uniform(1, 2, (40, 1))])
    count, _, forest = covertree.links_of(x / np.linalg.norm(x, axis=1, keepdims=True), np.ones(640, np.int64), None, None, 0.93)
    assert (count[:600] == 599).all() and (count[600:] == 39).all() and len(forest) == 599 + 39


def test_null_ids(spark):
    """Rows without an id, with different texts and a repeated one, are rows like others."""
    texts = ["one two three", "four five", "four five", None, ""]
    df = spark.createDataFrame([(None, x) for x in texts] + [(7, "one two")], "doc_id long, text string")
    t = Tokenizer.from_file(path := public_tokenizers.path("word_bpe_49k.json"))
    want = sorted([hashlib.sha256(np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for x in texts])
    assert sorted(r.ids_sha256 for r in bpe.encode_digests(df, path).collect() if r.doc_id is None) == want
    packed = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sum(r.doc_id is None for r in packed) == 5 and len({(r.sequence_id, r.offset) for r in packed}) == 6
    fold = language.fold()
    scored = lm.score(df, df.where(fold != 1), fold == 1, classes=8, frequent=4).collect()
    assert len(scored) == 6 and all(r.held_out is None for r in scored if r.doc_id is None)
    vectors_ = spark.createDataFrame([(None, [1.0, 0.0]), (0, [1.0, 0.1]), (100, [0.0, 1.0]), (100, [0.5, 1.0])], "vec_id long, embedding array<double>")
    got = forest.search(vectors_).collect()
    assert {(r.query_id, r.vec_id) for r in got} <= {(0, 100), (100, 0)} and got


LONG_WORDS = 9_000_000


def test_long_text(spark):
    """A text of 50 MB runs through each operator whole, and through the pipeline."""
    r = np.random.default_rng(1)
    pool = np.array([f"w{i}" for i in range(3000)])
    x = " ".join(pool[r.integers(0, 3000, LONG_WORDS)].tolist())
    assert len(x) > 50_000_000
    tail = " ".join(x[-2000:].split()[1:])
    rows = [(1, x, "xx", "s"), (2, tail + " and its own end", "xx", "s"), (3, None, "xx", "s")]
    df = common.settle(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    n, own = len(x.split()), len(tail.split())
    got = table(substring.dedup_digests(df), "doc_id")
    assert (got[1].n_words, got[1].n_removed, got[2].n_removed, got[2].kept_sha256) == (n, 0, own, hashlib.sha256(b"and its own end").hexdigest())
    assert got[1].kept_sha256 == hashlib.sha256(x.encode()).hexdigest()
    w = Tokenizer.from_file(path := public_tokenizers.path("word_bpe_49k.json"))
    assert table(bpe.encode_digests(df, path), "doc_id")[1].ids_sha256 == hashlib.sha256(np.array(w.encode(x, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    scored = table(lm.score(df, df, F.lit(False), classes=16, frequent=50), "doc_id")
    assert (scored[1].n_tokens, scored[1].n_known, scored[2].n_tokens) == (n + 1, n + 1, own + 5) and np.isfinite(scored[1].score)
    held = df
    for _, stage in corpus_pipeline.STAGES:
        held = common.settle(stage(spark, held, SF))
    ids = {r.doc_id: r.doc_tokens for r in held.collect()}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert ids == {1: len(t.encode(x, add_special_tokens=False).ids) + 1, 2: len(t.encode("and its own end", add_special_tokens=False).ids) + 1}
    assert sum(r.length for r in held.collect()) == sum(ids.values())


def test_op7(spark):
    urls = [None, "no scheme", "HTTP://Sub.Example.NET:80/en/x?q#f", "http://net/fr", "http://a.net?x", "https://example.com/de/1", "https://xexample.com/de/1", "http://a.org/fr/", "http://a.org/de/"]
    got = table(urlrules.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")), "page_id")
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("", "", None, "allow") and got[1].host == ""
    assert (got[2].host, got[2].path, got[2].rule) == ("sub.example.net:80", "/en/x", None)
    assert [got[i].rule for i in (3, 4, 5, 6, 7, 8)] == ["net/", None, "example.com/de/", None, "org/fr/", None]
    rows = [(["a", "b"], "block")] * 20 + [(["a", "c"], "allow")] * 20
    rules = urlrules.mine(spark.createDataFrame(rows, "items array<string>, verdict string"), 0.1, 0.9)
    assert {(r[0], r[1]) for r in rules} == {(("b",), "block"), (("c",), "allow")}
    assert urlrules.Index(rules).match(["b", "z"]) == ("block", 1.0) and urlrules.Index(rules).match(["a"]) is None
    assert urlrules.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def url_tokens(url):
    """Host, path and tokens by hand."""
    import re

    if url is None or "://" not in url:
        return "", "", []
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    keys = re.match(r"[^?#]*\?([^#]*)", url)
    low = "".join(c.lower() if c.isascii() else c for c in host)
    number = lambda x: re.sub("[0-9]+", "#", x)
    parts = low.split(".")
    out = ["host:" + ".".join(parts[i:]) for i in range(len(parts))] if low else []
    out += [f"path{i}:{number(w)}" for i, w in enumerate(x for x in path.split("/") if x)]
    out += ["key:" + number(k.split("=", 1)[0]) for k in (keys[1] if keys else "").split("&") if k]
    return low, path, list(dict.fromkeys(out))


def test_op7_mined_verdicts_by_brute_force(spark):
    """All sets of tokens, counted one by one; among them tokens that always stand together, ties and repeated rows."""
    import itertools

    r = random.Random(5)
    hosts = ["a.net", "b.net", "www.example.net", "c.org", "d.org", "example.com", "e.io", "f.io"]
    urls = [None, "x"] + [f"http://{r.choice(hosts)}/{r.choice(['en', 'de', 'fr'])}/{r.choice(['ad', 'p1', 'p2'])}" + r.choice(["", "?id=1", "?id=2&q=z#f"]) for _ in range(250)]
    urls += urls[:20]
    support, confidence = 0.05, 0.8
    got = urlrules.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), support=support, confidence=confidence)
    got = table(got, "page_id")
    rows = []
    for u in urls:
        host, path, tokens = url_tokens(u)
        fits = [(len(h + p), h + p, v) for h, p, v in urlrules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rows.append((tokens, max(fits)[1:] if fits else (None, None)))
    learn = [(set(t), v) for t, (_, v) in rows if v and t]
    where = {t: frozenset(i for i, (ts, _) in enumerate(learn) if t in ts) for ts, _ in learn for t in ts}
    frequent = {t: w for t, w in where.items() if len(w) >= support * len(learn)}
    item = {t: min(u for u in frequent if frequent[u] == frequent[t]) for t in frequent}
    share = sum(v == "block" for _, v in learn) / len(learn)
    tells = lambda t: abs(sum(learn[i][1] == "block" for i in where[t]) / len(where[t]) - share)
    assert len(item) > len(set(item.values())) > 5
    count, total = {}, {}
    for ts, v in learn:
        own = sorted(sorted({item[t] for t in ts if t in item}, key=lambda t: (-tells(t), len(where[t]), t))[: urlrules.TOKENS])
        for n in range(1, len(own) + 1):
            for c in itertools.combinations(own, n):
                total[c] = total.get(c, 0) + 1
                count[c, v] = count.get((c, v), 0) + 1
    rules = [(c, v, n / total[c], n / len(learn)) for (c, v), n in count.items() if n >= support * len(learn) and n / total[c] >= confidence]
    rules = [x for x in rules if not any(set(y[0]) < set(x[0]) and y[1] == x[1] and y[2] >= x[2] for y in rules)]
    rules.sort(key=lambda x: (-x[2], -x[3], x[0], x[1]))
    for i, (ts, (rule, verdict)) in enumerate(rows):
        own = {item[t] for t in ts if t in item}
        best = next((v for c, v, _, _ in rules if set(c) <= own), None)
        assert (got[i].rule, got[i].verdict, got[i].mined) == (rule, verdict or best or "allow", best), urls[i]
    assert {"block", "allow"} <= {v for _, v, _, _ in rules}


def test_op7_many_tokens_that_stand_together(spark):
    """A host of 30 fixed tokens has 2 ** 30 sets of tokens, but one item."""
    deep = "/".join(f"w{i}" for i in range(30))
    labelled = spark.createDataFrame([([*(f"path{i}" for i in range(30)), f"k{j % 3}"], "block" if j % 3 else "allow") for j in range(60)], "items array<string>, verdict string")
    item, tells = urlrules.items_of(labelled, 0.1)
    assert len(set(item.values())) == len(tells) == 4
    assert urlrules.filter_urls(spark.createDataFrame([(i, f"http://a.net/{deep}/{i % 3}") for i in range(60)], "page_id long, url string")).count() == 60


def test_op7_rules_over_more_than_eight_items(spark):
    """Two keys that say nothing one by one, and all together, count on urls with ten other items that each say a little."""
    import itertools

    r = random.Random(11)
    url = lambda host, keys: f"http://{host}/?" + "&".join(f"{k}=1" for k in keys)
    learn = []
    for verdict, host in (("block", "a.io"), ("allow", "b.io")):
        for i in range(200):
            noise = [f"n{chr(97 + j)}" for j in range(10) if r.random() < (0.75 if verdict == "block" else 0.6)]
            x, y = (i % 2, i % 2) if verdict == "allow" else (i % 2, 1 - i % 2)
            learn.append((host, [*noise, *["x"] * x, *["y"] * y], verdict))
    asked = [[*(f"n{chr(97 + j)}" for j in range(10)), *more] for more in ([], ["x"], ["x", "y"])] + [["x", "y"], ["y"], ["nothing"]]
    urls = [url(h, keys) for h, keys, _ in learn] + [url("c.com", keys) for keys in asked]
    support, confidence = 0.05, 0.6
    rules = [("a.io", "/", "block"), ("b.io", "/", "allow")]
    got = table(urlrules.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules, support=support, confidence=confidence), "page_id")
    rows = [(frozenset(keys), v) for _, keys, v in learn]
    best = {}
    for keys in asked:
        found = []
        for n in range(1, len(keys) + 1):
            for c in itertools.combinations(sorted(f"key:{k}" for k in keys), n):
                hits = [v for own, v in rows if all(k[4:] in own for k in c)]
                found += [(-hits.count(v) / len(hits), -hits.count(v), c, v) for v in ("block", "allow") if hits.count(v) >= support * len(rows) and hits.count(v) / len(hits) >= confidence]
        # of sets that occur as often, the one that has no part among them
        found = [f for f in found if not any(set(p[2]) < set(f[2]) and p[3] == f[3] and p[0] <= f[0] for p in found)]
        best[tuple(keys)] = min(found, default=(None, None, None, None))
    for i, keys in enumerate(asked, len(learn)):
        confidence_, _, _, verdict = best[tuple(keys)]
        assert (got[i].mined, got[i].verdict, got[i].confidence) == (verdict, verdict or "allow", confidence_ and -confidence_), keys
    assert got[len(learn) + 2].mined == "allow" and got[len(learn) + 2].confidence == 1.0


def test_op7_nested_items_do_not_multiply(spark):
    """A host of 24 labels whose suffixes are frequent to different degrees: 2 ** 24 frequent sets, of which few are worth a look."""
    labels = [f"l{i}" for i in range(24)]
    urls = [f"http://{'.'.join(labels[i % 24 :])}.{'net' if j % 5 else 'org'}/{'fr' if j % 3 else 'de'}" for j in range(20) for i in range(24)]
    got = urlrules.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    assert got.count() == len(urls)


def brute_near(texts, size, percent):
    sets = []
    for x in texts:
        w = common.lower_words_of(x)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    low = list(range(len(sets)))
    for _ in range(20):
        low = [min([low[i], *(low[j] for j in range(len(sets)) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]))]) for i in range(len(sets))]
    return [len(s) for s in sets], low


def test_op8(spark, docs, empty):
    n, low = brute_near(TEXTS, 3, 85)
    got = table(setsketch.digests(docs), "doc_id")
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(TEXTS))] == [(n[i], low[i], low[i] == i) for i in range(len(TEXTS))]
    assert setsketch.digests(empty).count() == 0 and setsketch.dedup(empty).columns == docs.columns


def test_op8_ids_shared_by_different_texts(spark):
    """Null ids and a repeated id: each row is judged by its own text, and goes by its own text."""
    near = lambda x: x.rsplit(" ", 1)[0] + " other"
    r = random.Random(9)
    a, b, c, d, e = (" ".join(r.choices(WORDS, k=120)) for _ in range(5))
    rows = [(1, a), (2, b), (9, c), (9, d), (12, near(c)), (13, near(d)), (None, a), (None, near(b)), (None, e), (7, near(a)), (7, "all its own"), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(1, a), (2, b), (9, c), (9, d), (None, e), (7, "all its own"), (None, None), (None, "")]
    assert sorted(map(tuple, setsketch.dedup(df).collect()), key=str) == sorted(kept, key=str)
    n = {x: len(set(zip(*(x.split()[i:] for i in range(3)), strict=False))) for _, x in rows if x}
    want = [(1, n[a], 1, True), (2, n[b], 2, True), (9, n[c], 9, True), (9, n[d], 9, True), (12, n[near(c)], 9, False), (13, n[near(d)], 9, False), (None, n[a], 1, False)]
    want += [(None, n[near(b)], 2, False), (None, n[e], None, True), (7, n[near(a)], 1, False), (7, 1, 7, True), (None, 0, None, True), (None, 0, None, True)]
    assert sorted(map(tuple, setsketch.digests(df).collect()), key=str) == sorted(want, key=str)


def test_op8_large_near_group(spark, monkeypatch):
    """Copies whose pairs lie around the threshold: stars alone would part them, the sweep must not."""
    monkeypatch.setattr(setsketch, "BLOCK", 16)
    words = [f"v{i}" for i in range(150)]
    texts = []
    for i in range(70):
        w = words[:]
        for _ in range(g.randrange(1, 9)):
            w[g.randrange(150)] = f"z{g.randrange(10**6)}"
        texts.append(" ".join(w))
    n, low = brute_near(texts, 3, 85)
    got = table(setsketch.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "doc_id")
    assert [got[i].component_id for i in range(70)] == low and 1 < len(set(low)) < 70


def test_op8_estimate():
    r = np.random.default_rng(1)
    a, b = (r.integers(0, 2**63, 2000, dtype=np.uint64) for _ in range(2))
    for k in (0, 1000, 1800):
        x, y = np.unique(a), np.unique(np.concatenate([a[:k], b[k:]]))
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        est = setsketch.estimate(setsketch.registers(x)[None], setsketch.registers(y)[None], np.array([2000.0]), np.array([2000.0]))[0]
        assert abs(est - true) < 0.12
    assert (setsketch.merge(setsketch.registers(x), setsketch.registers(y)) == setsketch.registers(np.union1d(x, y))).all()


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_op8_estimate_drops_no_pair_at_the_threshold(similarity):
    """Pairs of equal-sized sets of just that similarity, with independent registers."""
    r = np.random.default_rng(5)
    n, m = 1000.0, setsketch.BANDS * setsketch.ROWS
    union = 2 * n / (1 + similarity)
    for _ in range(3):
        both, one, two = (r.exponential(size=(20_000, m)) / (size * setsketch.RATE) for size in (similarity * union, *[(1 - similarity) / 2 * union] * 2))
        a, b = (np.floor(1 - np.log(np.minimum(both, x)) / np.log(setsketch.BASE)) for x in (one, two))
        size = np.full(20_000, n)
        assert (setsketch.estimate(a, b, size, size) >= similarity - setsketch.SLACK).all()


def check_packing(rows, texts, encode):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, x in enumerate(texts):
        ids, at = np.array([*encode(x or ""), 1], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return len(by_sequence)


def test_op9(docs, empty):
    t = Tokenizer.from_file(path := public_tokenizers.path("byte_bpe_50k.json"))
    check_packing(packing.pack(docs, path).collect(), TEXTS, lambda x: t.encode(x, add_special_tokens=False).ids)
    ids_of = packing.TextIds(open(path, encoding="utf-8").read())
    assert ids_of.plain
    for x in ["a" + chr(c) + "1 " + chr(c) + "!'s" for c in range(0x80, 0x32000, 3) if not 0xD800 <= c < 0xE000] + ["ab" * 20_000, " " * 1_000_000 + "x", " " * 19_999 + "x", "ab" * 3_000_000, "\n \n" * 10_000, "1" * 9000]:
        assert ids_of(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
    assert packing.pack(empty, path).count() == 0


def test_op9_plan_is_tight():
    demand = np.bincount(np.random.default_rng(3).integers(0, 64, 3000), minlength=64)
    steps = packing.plan(demand, 64)
    assert (sum(p * n for p, n in steps) == demand).all() and all(p @ (np.arange(64) + 1) <= 64 for p, _ in steps)
    assert sum(n for _, n in steps) <= 1.02 * (demand @ (np.arange(64) + 1)) / 64 + 5
    value, pattern = packing.best_pattern(np.array([1.0, 2.5, 3.0]), 7)
    assert value == 8.5 and pattern @ np.array([1, 2, 3]) <= 7


def test_op10(spark, docs, empty):
    fold = language.fold()
    got = table(lm.score(docs, docs.where(fold != 1), fold == 1, classes=16, frequent=30), "doc_id")
    train = [x for i, x in enumerate(TEXTS) if zlib.crc32(str(i).encode()) % 5 != 1]
    count = {}
    for x in train:
        for w in common.lower_words_of(x):
            count[w] = count.get(w, 0) + 1
    total, distinct = sum(count.values()) + len(train), len(count) + 1
    for i, x in enumerate(TEXTS):
        w = common.lower_words_of(x)
        c = [*(count.get(k, 0) for k in w), len(train)]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (len(c), sum(k > 0 for k in c), total, zlib.crc32(str(i).encode()) % 5 == 1)
        assert abs(got[i].base_score - sum(np.log10((k + 0.5) / (total + 0.5 * (distinct + 1))) for k in c)) < 1e-6
        assert got[i].score < 0
    assert lm.score(empty, empty, fold == 1).count() == 0


def test_op10_score_by_brute_force(spark, docs):
    """Each token's probability from the model's own parameters, one after the other; and those of all words sum to one."""
    fold, classes, frequent = language.fold(), 16, 30
    learn = docs.where(fold != 1)
    counts, top, known = lm.vocabulary(learn, classes, frequent)
    model = lm.train(learn, spark.sparkContext.broadcast(known), classes)
    got = table(lm.score(docs, learn, fold == 1, classes=classes, frequent=frequent), "doc_id")
    n = {bytes(r.word): r.n for r in counts.collect()}
    of = {bytes(r.word): i + 2 for i, r in enumerate(top[: classes - 2])}
    others = {w: k for w, k in n.items() if w not in of}
    unit = sum(others.values()) + 0.5 * (len(others) + 1)
    q = lambda x: model.bias[x] + model.target[x] @ (model.context[far] @ model.turn[0] + model.context[near] @ model.turn[1])
    for i, x in enumerate(TEXTS):
        far, near, want = lm.END, lm.END, 0.0
        for w in [*common.lower_words_of(x), None]:
            c = lm.END if w is None else of.get(w, lm.OTHER)
            s = np.array([q(k) for k in range(classes)])
            want += (s[c] - np.log(np.exp(s).sum())) / np.log(10)
            if c == lm.OTHER:
                want += np.log10((others.get(w, 0) + 0.5) / unit)
            far, near = near, c
        assert abs(got[i].score - want) < 1e-6 * (1 + abs(want))
    assert abs(sum((k + 0.5) / unit for k in [*others.values(), 0]) - 1) < 1e-9


def test_op10_followers_are_all_counted(spark, docs):
    known = {b"w1": (9, 2), b"w2": (9, 3)}
    got = {(r.context, r["class"]): r.n for r in lm.followers(docs, spark.sparkContext.broadcast(known), 4).collect()}
    want = {}
    for x in TEXTS:
        ids = [1, 1, *({b"w1": 2, b"w2": 3}.get(w, 0) for w in common.lower_words_of(x)), 1]
        for a, b, c in zip(ids, ids[1:], ids[2:], strict=False):
            want[4 * a + b, c] = want.get((4 * a + b, c), 0) + 1
    assert got == want


def test_op10_learns_from_all_contexts(spark):
    """Contexts beyond the 64 most frequent ones tell what follows: words that go in a ring, rarer than words drawn at random."""
    r = random.Random(3)
    ring = [f"b{i}" for i in range(12)]
    texts = [" ".join(r.choice("stuvwxyz") for _ in range(20_000)) for _ in range(3)] + [" ".join(ring * 200) for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = 24
    counts, top, known = lm.vocabulary(df, classes, 100)
    shared = spark.sparkContext.broadcast(known)
    model = lm.train(df, shared, classes, contexts=64)
    of, n = {w: known[w.encode()][1] for w in ring}, {bytes(x.word): x.n for x in top}
    p = model.log_probabilities(np.array([(of[ring[i - 2]], of[ring[i - 1]]) for i in range(12)]))
    gain = [p[i, of[w]] - np.log10(n[w.encode()] / sum(n.values())) for i, w in enumerate(ring)]
    assert min(gain) > 0.3
    again = lm.train(df, shared, classes, contexts=64)
    assert np.allclose(model.state(), again.state(), rtol=1e-9, atol=1e-12)


def test_op10_shards_hold_every_count(spark, docs):
    known = {b"w%d" % i: (9, i + 2) for i in range(6)}
    found = lm.followers(docs, spark.sparkContext.broadcast(known), 8)
    shards = lm.dealt(found, 8, 5).collect()
    got = [((int(own[i]), int(c)), int(k)) for _, own, row, now, n in shards for i, c, k in zip(row, now, n, strict=True)]
    assert sorted(got) == sorted(((x.context, x["class"]), x.n) for x in found.collect()) and len(shards) > 1
    assert sum(len(own) for _, own, *_ in shards) == found.select("context").distinct().count()


def test_op10_model():
    """A model of two places learns which classes follow which, and its tables are its probabilities."""
    r = np.random.default_rng(0)
    a, b = r.normal(size=(2, 6, 6)) * 1.5
    contexts = np.array([(i, j) for i in range(6) for j in range(6)])
    p = np.exp(a[contexts[:, 0]] + b[contexts[:, 1]])
    p /= p.sum(1, keepdims=True)
    counts = np.round(p * 10_000)
    model = lm.LogBilinear(6, width=8).fit(contexts, counts, counts.sum(0) / counts.sum(), epochs=2500)
    q = 10 ** model.log_probabilities(contexts)
    # the objective asks for scores that sum to one by themselves, which two places' sum can only come near
    assert np.allclose(q.sum(1), 1) and np.abs(q - p).mean() < 0.04 and (p * np.log(p / q)).sum(1).mean() < 0.05 * (p * np.log(p / p.mean(0))).sum(1).mean()
    places, sums = model.tables()
    assert np.allclose(places[0][contexts[:, 0]] + places[1][contexts[:, 1]] - sums[contexts[:, 0], contexts[:, 1]][:, None], np.log(q))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    same(queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.oracle_sql()[name]).df())


def test_op10_beats_unigrams(spark):
    got = queries.op10_log_bilinear(spark, SF).where("held_out").toPandas()
    assert got["score"].sum() > got["base_score"].sum()


def test_pipeline_language_with_clashing_columns(spark):
    rows = [(0, "some words", "xx", 3.5, "a", "m", "t"), (1, "...", "xx", None, None, None, None), (2, "more words", None, 0.0, "und", None, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, Score double, lang_pred string, mixture string, _text_ string")
    got = corpus_pipeline.language_id(spark, df, SF)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]


def test_stages_with_clashing_columns(spark):
    """Columns with the names that stages and operators use themselves stay as they are; the last stage has its own."""
    clash = ["score", "lang_pred", "mixture", "_doc_", "_hash_", "_ranges_", "_text_", "doc", "text_hash", "ranges", "may", "first", "n", "digest", "component", "_1_", "a b", "length", "start"]
    rows = [(i, x, None if i % 4 == 0 else "xx", *(f"{c}{i}" for c in clash)) for i, x in enumerate([BASE, BASE, LONG, text(200) + " " + LONG, "..."])]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", *clash])
    for _, stage in corpus_pipeline.STAGES[:3]:
        df = common.settle(stage(spark, df, SF))
        assert df.columns == ["doc_id", "text", "lang", *clash]
    got = {r[0]: r for r in df.collect()}
    assert set(got) == {0, 2, 3} and all(tuple(r)[2:] == rows[i][2:] for i, r in got.items()) and len(got[3].text.split()) == 200
    assert corpus_pipeline.packing_plan(spark, df, SF).count() >= 3


def test_pipeline(spark, docs, empty):
    held = docs
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        held = common.settle(stage(spark, held, SF))
        if i < 3:
            assert held.columns == docs.columns
            kept.append({r.doc_id for r in held.collect()})
            texts = {r.doc_id: r.text for r in held.collect()}
    left = [i for i, x in enumerate(TEXTS) if x and any(c.isalpha() for c in x)]
    assert kept[0] == set(left)
    _, low = brute_near([TEXTS[i] for i in left], 5, 80)
    assert kept[1] == kept[2] == {left[i] for i in range(len(left)) if low[i] == i}
    stay = sorted(kept[1])
    assert [len(common.words_of(texts[i])) for i in stay] == [n - gone for n, gone, _ in brute_substring([TEXTS[i] for i in stay])]
    assert sum(r.length for r in held.collect()) == sum({r.doc_id: r.doc_tokens for r in held.collect()}.values())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
