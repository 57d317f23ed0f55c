"""Mixing, the Merkle manifest and lexical search: brute force on small tables; nulls, empty and long texts, ties, repeated rows."""

import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from gleaner.llm import lexical, merkle, mixing, queries

#: Extra columns have the names of outputs, as rows of any table may.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, leaf string, score string, block string"
WORDS = [f"w{i}" for i in range(40)]


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, None, None, "x", "y", "z") for r in rows], DOCS)


def texts(n, seed=5):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, int(k))).capitalize() for k in rng.integers(1, 90, n)]


@pytest.fixture(scope="module")
def rows():
    made = [(i, t, ("de", "en", None, "")[i % 4], ("a", "b", "c", None, "é")[i % 5]) for i, t in enumerate(texts(90))]
    odd = [(1000, None, "de", "a"), (1001, "", "en", "b"), (1002, " \t ", None, "c"), (1003, "Only ONE É é", "zz", "lonely"), (1004, "w1 " * 7000, "en", "b"), (None, "w1 w2 W3", "de", "a"), (None, None, None, None)]
    return made + odd + [(None, "w1 w2 W3", "de", "a")] * 20 + [(5, made[5][1], made[5][2], made[5][3])] * 2 + [(6, "w3 w4", "fr", "b"), (6, "w4 w3", "fr", "b")]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# -- op11 ------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000])
def test_permutations_are_bijections_and_go_back(n):
    for key in (0, 1, 2**40):
        p = mixing.permuted(np.arange(n), n, key)
        assert sorted(p.tolist()) == list(range(n)) and (mixing.permuted(p, n, key, back=True) == np.arange(n)).all()


@pytest.mark.parametrize("sizes", [[10, 0, 1000, 5], [1], [0, 0], [7, 7, 7], [1, 1, 1, 1, 10**12], []])
def test_shares_by_hand(sizes):
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    got = mixing.shares(sizes, weights)
    # poured in by thin layers: each open source gets its weight's part until it is full
    assert sum(got) == sum(sizes) and all(0 <= t <= 3 * s for t, s in zip(got, sizes, strict=True))
    open_ = [t / w for t, w, s in zip(got, weights, sizes, strict=True) if t < 3 * s]
    assert len(set(open_)) <= 1 and all(t / w <= (open_ or [Fraction(10**18)])[0] for t, w in zip(got, weights, strict=True))


def test_tree_splits_quotas_exactly_and_anywhere():
    quotas = np.array([700, 0, 31, 1, 268])
    tree = mixing.Tree(quotas, 37, 3)
    leaves = list(tree.leaves(0, 37))
    assert [s for s, _, _ in leaves] == list(range(37))
    assert sum(q for _, q, _ in leaves).tolist() == quotas.tolist()
    assert {int(q.sum()) for _, q, _ in leaves} <= {26, 27, 28}
    at = np.zeros(5, np.int64)
    for _, q, start in leaves:  # runs lie behind one another
        assert start.tolist() == at.tolist()
        at += q
    for (a, q, s), (b, r, t) in zip(leaves[11:20], tree.leaves(11, 20), strict=True):
        assert a == b and q.tolist() == r.tolist() and s.tolist() == t.tolist()


def test_tree_draws_without_replacement():
    """Over many seeds a half's share of a source has the mean and variance of a hypergeometric draw."""
    got = [next(mixing.Tree(np.array([30, 70]), 2, seed).leaves(0, 1))[1][0] for seed in range(3000)]
    assert abs(np.mean(got) - 15) < 0.2 and abs(np.var(got) - 50 * 0.3 * 0.7 * 50 / 99) < 0.5


def test_op11(spark, rows):
    docs = rows_of(spark, rows)
    how = {"block": 16, "shard": 400}
    runs = [r.asDict() for r in mixing.mix(docs, **how).collect()]
    got = mixing.taken_words(docs, **how).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(words(r[1])) for r in rows if r[3] == s) for s in names]
    targets = mixing.shares(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    by = defaultdict(int)
    for r in runs:
        by[r["source"]] += r["length"] or 0
    assert {s: by[s] for s in names} == {s: round(t) for s, t in zip(names, targets, strict=True)}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.target == float(targets[sizes.index(r.source_size)] if sizes.count(r.source_size) == 1 else r.target)
    # a copy has no word of a source twice, and blocks of a shard have places 0, 1, 2, ...
    seen, places = set(), defaultdict(set)
    for r in runs:
        if r["length"]:
            span = {(r["source_no"], r["copy"], r["row_begin"] + r["start"] + i) for i in range(r["length"])}
            assert not span & seen and 0 <= r["start"] and r["start"] + r["length"] <= r["size"]
            seen |= span
            places[r["shard"]].add(r["place"])
    assert len(places) > 3 and all(p == set(range(len(p))) for p in places.values())
    # reruns agree, however the rows lie
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(mixing.taken_words(docs.repartition(7, "text"), **how).collect(), key=key) == sorted(got, key=key)
    text = {(s, d, len(words(t))): words(t) for d, t, _, s in rows if d is not None and d != 6}
    shards = mixing.shard_texts(docs, mixing.mix(docs, **how)).collect()
    assert sum(len(words(r.text)) for r in shards) == sum(by.values())
    want = Counter((r["shard"], r["place"], r["doc_id"], " ".join(text[r["source"], r["doc_id"], r["size"]][r["start"] : r["start"] + r["length"]])) for r in runs if r["length"] and r["doc_id"] not in (None, 6))
    assert Counter((r.shard, r.place, r.doc_id, r.text) for r in shards if r.doc_id not in (None, 6)) == want


def test_op11_registered_parameters_and_empty(spark, rows):
    assert mixing.taken_words(rows_of(spark, [])).count() == 0
    none = mixing.taken_words(rows_of(spark, [(1, None, None, None), (None, "", "a", "b")])).collect()
    assert sorted((r.doc_id or 0, r.size, r.source_size, r.target, r.taken) for r in none) == [(0, 0, 0, 0.0, 0), (1, 0, 0, 0.0, 0)]
    by = defaultdict(lambda: [0, 0])
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op11_splitting_tree(spark, SF).collect():
        by[docs[r.doc_id]][0] += r.taken
        by[docs[r.doc_id]][1] = r.target
    assert all(abs(taken - target) <= 0.5 for taken, target in by.values())


# -- op12 ------------------------------------------------------------------------------------


def H(x):
    return sha256(x.encode()).hexdigest()


def risen(level):
    """All levels of a tree over these digests."""
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def proof_of(levels, i):
    out = []
    for level in levels[:-1]:
        low = i // 8 * 8
        out.append((level[low:i], level[i + 1 : low + 8]))
        i //= 8
    return out


def test_op12(spark, rows):
    rows = [r for r in rows if r[2] != "de" or r[0] is None or r[0] > 40]  # groups of one leaf and of three levels
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for d, t, lang, s in rows:
        leaf = lambda x: H("".join(map(f, (d, s, lang, None, x))))  # noqa: B023, E731
        low = t is not None and d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        now = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) if low else t
        groups[lang].append((d is None, d or 0, leaf(t), leaf(now)))
    trees = {g: risen([x[2] for x in sorted(v)]) for g, v in groups.items()}
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    top = risen([trees[g][-1][0] for g in names])
    root, want = top[-1][0], []
    for g in names:
        for i, (void, d, leaf, now) in enumerate(sorted(groups[g])):
            path = proof_of(trees[g], i) + proof_of(top, names.index(g))
            folded = now
            for before, after in path:
                folded = H("".join([*before, folded, *after]))
            want.append((None if void else d, leaf, trees[g][-1][0], root, H("".join(x for p in path for side in p for x in side)), folded, folded == root))
    got = [tuple(r) for r in merkle.tampered_manifest(rows_of(spark, rows).repartition(5)).collect()]
    assert Counter(got) == Counter(want)
    assert {len(v) for v in groups.values()} >= {1} and {r[6] for r in got} == {True, False}


def test_op12_one_group_one_row_and_none(spark):
    assert merkle.tampered_manifest(rows_of(spark, [])).count() == 0
    (r,) = merkle.tampered_manifest(rows_of(spark, [(7, "x", None, None)])).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root == H("1:7---1:x") and r.proof_sha256 == H("") and r.verified
    got = merkle.tampered_manifest(rows_of(spark, [(i, None, "en", None) for i in range(65)])).collect()
    assert len({r.root for r in got}) == 1 and all(r.verified and r.subroot == r.root for r in got)


def test_op12_lost_children_are_an_error():
    with pytest.raises(RuntimeError, match="7 children"):
        merkle._parent((("=en", 0), (9, tuple((i, "x") for i in range(7)))))
    assert merkle._parent((("=en", 1), (9, ((8, "x"),))))[:3] == ("=en", 1, 2)


# -- op13 ------------------------------------------------------------------------------------

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(t):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def ranked(docs, items, k):
    docs = [(d, Counter(terms(t))) for d, t in docs]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, size in docs:
            m = 50 + 50 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                found.append((-s, d is None, d))
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def items_of(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, rank int")


ITEMS = [(0, "w1 w2 w3 W4, w4!"), (1, None), (2, ""), (3, "nowhere"), (4, "É only"), (5, " ".join(WORDS)), (5, "w7"), (None, "w9 one"), (8, "w1-w1_w1")]


def test_op13(spark, rows, monkeypatch):
    docs = [(r[0], r[1]) for r in rows]
    frame = rows_of(spark, rows)
    for k in (3, 50, 1000):
        got = [tuple(r) for r in lexical.search(frame, items_of(spark, ITEMS), k).collect()]
        assert Counter(got) == Counter(ranked(docs, ITEMS, k))
    # many blocks, groups of items and lots give the same
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 9)
    monkeypatch.setattr(lexical, "GROUP_ITEMS", 2)
    monkeypatch.setattr(lexical, "LOT_PAIRS", 20)
    got = [tuple(r) for r in lexical.search(frame.repartition(5), items_of(spark, ITEMS), 7).collect()]
    assert Counter(got) == Counter(ranked(docs, ITEMS, 7))


def test_op13_empty(spark, rows):
    assert lexical.search(rows_of(spark, []), items_of(spark, ITEMS)).count() == 0
    assert lexical.search(rows_of(spark, rows), items_of(spark, [])).count() == 0


def test_terms_of_long_texts_are_not_cut():
    for t in ("ab " * 700_000, "x" * 3_000_000, "é" * 600_000 + " A.b" * 300_000, ("y" * 5000 + "-") * 500):
        got = [w for part in lexical.parts_of(t.encode()) for w in part]
        assert got == [w.encode() for w in terms(t)]


def test_slices_add_and_rank_like_integers():
    rng = np.random.default_rng(1)
    docs, items, width = 500, 6, 40
    sums, plain = np.zeros((width, items, 8), np.uint64), np.zeros((items, docs), np.int64)
    for _ in range(30):
        of = np.flatnonzero(rng.random(items) < 0.6)
        places = np.flatnonzero(rng.random(docs) < 0.3)
        values = rng.integers(0, 2 ** int(rng.integers(1, 34)), len(places))
        if not len(of) or not len(places) or values.max() == 0:
            continue
        exists = np.zeros(docs, bool)
        exists[places] = True
        lexical.add(sums, of, lexical.spread(np.packbits(exists).tobytes(), lexical.sliced(values).tobytes(), docs))
        plain[np.ix_(of, places)] += values
    plain[:, 40:60] = plain[:, 40:41]  # ties
    for i in range(items):
        for b in range(width):
            bits = np.zeros(512, bool)
            bits[:docs] = plain[i] >> b & 1
            sums[b, i] = np.packbits(bits).view(np.uint64)
    for k in (1, 5, 45, 499, 2000):
        sure, tied = lexical.best(sums, k)
        for i in range(items):
            a, b = lexical._places(sure[i]), lexical._places(tied[i])
            got = sorted([*a, *b[: k - len(a)]], key=lambda p: (-plain[i, p], p))
            assert got == [p for p in sorted(range(docs), key=lambda p: (-plain[i, p], p)) if plain[i, p] > 0][:k]
            assert lexical.scores(sums, i, np.array(got, np.int64)).tolist() == plain[i, got].tolist()
    with pytest.raises(OverflowError):
        lexical.add(np.full((2, 1, 1), 2**64 - 1, np.uint64), np.array([0]), np.full((1, 1), 1, np.uint64))


def test_op12_and_op13_registered(spark, duck):
    from conftest import same

    for name in ("op12_merkle_manifest", "op13_bit_sliced"):
        same(queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.oracle_sql()[name]).df())
    assert queries.op13_bit_sliced(spark, SF).where(F.col("rank") > 50).count() == 0
