"""Proportions of languages against all subsets of them, in plain Python."""

import itertools
import math
import re
from collections import Counter

import pytest

from gleaner.llm import language
from gleaner.llm.common import odd_numbers

WORDS = {
    "de": "der hund und die katze laufen durch den garten weil sie hunger haben und nicht schlafen wollen".split(),
    "en": "the dog and the cat run through the garden because they are hungry and will not go to sleep".split(),
    "fr": "le chien et le chat courent dans le jardin parce qu'ils ont faim et ne veulent pas dormir".split(),
}


def said(lang, n, start=0):
    return " ".join(WORDS[lang][(start + 3 * i) % len(WORDS[lang])] for i in range(n))


def cells(text):
    """Counts of hashed trigrams, one by one."""
    a, b, d = (int(x) for x in odd_numbers(3, 11))
    u64 = (1 << 64) - 1
    low = re.sub(" +", " ", " " + "".join(x if x.isalpha() else " " for x in text.lower()) + " ")
    out = Counter()
    for x, y, z in zip(low, low[1:], low[2:], strict=False):
        y = ord(y) * b & u64
        h = ((ord(x) * a & u64) + (y ^ y >> 29) + (ord(z) * d & u64)) & u64
        h = (h ^ h >> 31) * a & u64
        out[(h >> 50) % language.CELLS] += 1
    return out


def model_of(rows):
    sums = {}
    for text, lang in rows:
        sums.setdefault(lang, Counter()).update(cells(text))
    share = {}
    for lang, n in sums.items():
        total = sum(n.values()) + language.SMOOTHING * language.CELLS
        share[lang] = lambda c, n=n, total=total: (n[c] + language.SMOOTHING) / total
    return share


def mixture(n, share, chosen, steps=400):
    """EM to its end: log-likelihood and proportions."""
    p = {lang: {c: share[lang](c) for c in n} for lang in chosen}
    w, total = dict.fromkeys(chosen, 1 / len(chosen)), sum(n.values())
    for _ in range(steps):
        mixed = {c: sum(w[x] * p[x][c] for x in chosen) for c in n}
        w = {x: w[x] / total * sum(k * p[x][c] / mixed[c] for c, k in n.items()) for x in chosen}
    return sum(k * math.log(sum(w[x] * p[x][c] for x in chosen)) for c, k in n.items()), w


def best(n, share):
    price = language.PENALTY * math.log(sum(n.values()) + 1)
    found = []
    for size in range(1, len(share) + 1):
        for chosen in itertools.combinations(sorted(share), size):
            fit, w = mixture(n, share, chosen)
            found.append((fit - (size - 1) * price, w))
    return max(found, key=lambda x: x[0])[1]


@pytest.fixture(scope="module")
def told(spark):
    learnt = [(said(lang, 200, at), lang) for lang in WORDS for at in range(3)]
    model = language.train(spark.createDataFrame(learnt, "text string, lang string"))
    return model, model_of(learnt)


def test_counts_are_those_of_single_trigrams():
    for text in ("The dog, 7 cats;  Ärger!", "a", said("fr", 50), "ſKİ x"):
        assert {i: n for i, n in enumerate(language.trigram_counts(text)) if n} == dict(cells(text))


def test_mixtures_are_the_best_of_all_subsets(spark, told):
    model, share = told
    parts = [("de", 60), ("en", 60), ("fr", 60)]
    texts = [said(x, 40) for x, _ in parts] + [said(a, n) + " " + said(b, 30) for (a, n), (b, _) in itertools.permutations(parts, 2)]
    texts += [" ".join(said(x, n + 40 * i) for i, (x, n) in enumerate(parts)), said("en", 200) + " der hund", "chat"]
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    sizes = set()
    for i, text in enumerate(texts):
        want = best(cells(text), share)
        sizes.add(len(want))
        assert set(got[i].mixture) == set(want), text
        assert all(abs(got[i].mixture[x] - want[x]) < 0.03 for x in want)
        assert got[i].lang_pred == max(want, key=want.get) and got[i].score == pytest.approx(got[i].mixture[got[i].lang_pred])
    assert sizes == {1, 2, 3}


def test_languages_that_can_not_be_told_apart(spark):
    """Two labels with equal texts tie: the first in byte order is taken, and the other adds nothing."""
    rows = [(said("en", 50), "b"), (said("en", 50), "a"), (said("fr", 50), "c")]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    (r,) = language.predict(spark.createDataFrame([(1, said("en", 20))], "doc_id long, text string"), model).collect()
    assert (r.lang_pred, r.mixture) == ("a", {"a": 1.0})
