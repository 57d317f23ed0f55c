"""Language identification as inference over a mixture.

Each language is a distribution over hashed character trigrams. For a document, expectation-maximisation
estimates the proportions of its languages from the likelihoods of its trigrams; the set of languages
grows from the best single one while the likelihood gains more than a penalty for the added parameter.

Defined cases: null text, empty text or text without a letter gives `und` with score 0; no usable
training rows give `und` for all; a tie goes to the language first in byte order; a null doc_id has a null fold,
so `held_out` is null and the row isn't learnt from; repeated rows give a
row each; an empty table gives an empty result. Whole texts are used, of any length.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import odd_numbers, ship

#: Cells that trigrams are hashed to. The model holds this many numbers for each language.
CELLS = 16_384
SMOOTHING = 0.5
#: Gain in log-likelihood asked for another language, as a multiple of log(number of trigrams).
PENALTY = 2.0
STEPS = 12
UNDETERMINED = "und"
#: Characters that are counted at once.
SLICE = 1 << 20
#: Languages that a model may have: a bound of the driver's table and of what is broadcast.
MOST_LANGUAGES = 400

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def trigram_counts(text: str | None) -> np.ndarray | None:
    """How often each cell occurs among trigrams of lower-cased letters; other characters are one blank. None without letters.

    Slices of a long text go one after the other, each with the two characters before it.
    """
    if not text:
        return None
    text, out, tail, some = text.lower(), np.zeros(CELLS, np.int64), np.array([32], np.uint32), False
    a, b, d = odd_numbers(3, 11)
    for at in range(0, len(text), SLICE):
        c = np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(letters()[c], c, 32)
        some = some or bool((c != 32).any())
        c = np.concatenate([tail, c, [32] if at + SLICE >= len(text) else []]).astype(np.uint64)
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        tail = c[-2:]
        h = c[:-2] * a + (c[1:-1] * b ^ (c[1:-1] * b >> np.uint64(29))) + c[2:] * d
        h = (h ^ (h >> np.uint64(31))) * a
        out += np.bincount((h >> np.uint64(50)).astype(np.int64) % CELLS, minlength=CELLS)
    return out if some else None


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in byte order and their distributions, languages x CELLS, from every row with a label."""
    ship(docs.sparkSession)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (n := trigram_counts(x)) is not None:
                    sums[y] = sums[y] + n if y in sums else n
        for y, n in sums.items():
            cells = np.flatnonzero(n)
            yield pa.record_batch([pa.array([y] * len(cells), pa.string()), pa.array(cells, pa.int32()), pa.array(n[cells], pa.int64())], names=["lang", "cell", "n"])

    if docs.select(F.col(lang).cast("string")).distinct().limit(MOST_LANGUAGES + 2).count() > MOST_LANGUAGES + 1:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()  # languages x CELLS rows at most
    langs = sorted(rows["lang"].unique(), key=lambda x: x.encode())
    n = np.zeros((len(langs), CELLS))
    for i, y in enumerate(langs):
        own = rows[rows["lang"] == y]
        n[i, own["cell"].to_numpy()] = own["n"].to_numpy()
    n += SMOOTHING
    return langs, n / n.sum(1, keepdims=True)


def infer(n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Proportions of the languages in a document with counts n; zero for those not selected."""
    cells = np.flatnonzero(n)
    n, p = n[cells].astype(float), p[:, cells]
    total, alone = n.sum(), np.log(p) @ n
    chosen, share = [int(np.argmax(alone))], np.ones(1)
    best, price = alone[chosen[0]], PENALTY * np.log(total + 1)
    while len(chosen) < len(p):
        found = None
        ratio = n / (share @ p[chosen])
        for i in range(len(p)):
            # concave in the proportion: no slope at 0, no gain
            if i in chosen or p[i] @ ratio <= total:
                continue
            q = p[[*chosen, i]]
            w = np.append(share * 0.9, 0.1)
            for _ in range(STEPS):
                w = w * (q @ (n / (w @ q))) / total
            if (score := np.log(w @ q) @ n) > best + price and (found is None or score > found[0]):
                found = score, i, w
        if found is None:
            break
        best, share = found[0], found[2]
        chosen.append(found[1])
    out = np.zeros(len(p))
    out[chosen] = share
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, lang_pred, score, mixture): score is the predicted language's proportion."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # CELLS numbers for each language
    names = [key, *keep]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    mixture = pa.map_(pa.string(), pa.float64())
    at = names.index(text) if text in names else len(names)  # a kept text travels once

    def run(batches):
        langs, p = shared.value
        for batch in batches:
            pred, score, mix = [], [], []
            for x in batch.column(at).to_pylist():
                n = trigram_counts(x) if langs else None
                w = np.zeros(0) if n is None else infer(n, p)
                i = int(np.argmax(w)) if len(w) else -1
                pred.append(langs[i] if len(w) else UNDETERMINED)
                score.append(min(1.0, float(w[i])) if len(w) else 0.0)
                mix.append([(langs[j], float(w[j])) for j in np.flatnonzero(w)])
            yield pa.record_batch([*batch.columns[: len(names)], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mix, mixture)], names=[*names, "lang_pred", "score", "mixture"])

    return docs.select(*names, *([] if text in names else [F.col(text).alias("_text_")])).mapInArrow(run, f"{kinds}, lang_pred string, score double, mixture map<string,double>")


def fold(key: str = "doc_id"):
    """crc32 of the key as text, modulo 5."""
    return F.crc32(F.col(key).cast("string")) % 5


def training_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.where(fold(key) != 0)
