"""Scoring with a log-bilinear language model trained by noise-contrastive estimation.

The model predicts the class of the next token from the CONTEXT tokens before it: each has a vector, each place a
matrix, s(w | v1, v2) = (r_v1 C1 + r_v2 C2) . q_w + b_w. Classes are the most frequent words, one for all other words,
and the end. How often each class follows each context is counted over all training rows, and the model is trained on all
contexts with all that follows them. They are dealt by hash to shards of CONTEXTS each, but for the most frequent ones, of which each
shard gets an equal part of the counts, so that shards weigh alike; in an epoch a task a shard takes the
model through its shard in numpy, and the mean of what the shards make of it goes into the next. The noise-contrastive objective is
taken over these counts in full (its expectation; no noise is drawn), with noise from the class frequencies. As scores add
up over places, a table for each place and the normalisers of all contexts, made by batched matrix products, give every
token's normalised log-probability. A word of the class of other words has that class's probability times its own
smoothed share among them, so the probabilities of all words, one unseen word and the end sum to one.

Counts of words are kept by a table in the shared folder; only the FREQUENT ones are broadcast, all others
are found by a join, so that every count is exact.

Defined cases: null and empty texts are the end alone; without training rows N and V are 0 and every
probability is that of an unseen token; null doc_id has a null remainder: it is not held out and not
learnt from; repeated rows give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_words_of, mix, most_frequent, settle, ship

CLASSES = 512
#: Tokens before that the model looks at. The normalisers are a table of CLASSES ** CONTEXT numbers.
CONTEXT = 2
#: Contexts of a shard, on average; a task holds one, with CLASSES counts for each context.
CONTEXTS = 8192
WIDTH = 24
NOISE = 10
EPOCHS, BATCH = 24, 512
FREQUENT = 150_000
#: Tokens drawn by class frequency that each context is taken to have been followed by, besides those counted. Beyond a shard's
#: contexts all share those of one shard: else what many seldom seen contexts fall back to outweighs all that was counted.
PRIOR = 100

OTHER, END = 0, 1


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts; counted by task before the shuffle."""
    ship(docs.sparkSession)

    def run(batches):
        held: Counter = Counter()
        flush = lambda: pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for x in batch.slice(at, 500).column(0).to_pylist():
                    held.update(lower_words_of(x))
                if len(held) > 400_000:
                    yield flush()
                    held = Counter()
        if held:
            yield flush()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class LogBilinear:
    """The model over classes; contexts are rows of CONTEXT classes, the nearest token last."""

    def __init__(self, classes: int, width: int = WIDTH, seed: int = 1):
        g = np.random.default_rng(seed)
        self.context, self.target = (g.normal(0, 0.1, (classes, width)) for _ in range(2))
        self.turn, self.bias = np.stack([np.eye(width)] * CONTEXT), np.zeros(classes)
        self.moments = [[np.zeros_like(p) for p in self.parameters()] for _ in range(2)]

    def parameters(self) -> list[np.ndarray]:
        return [self.context, self.turn, self.target, self.bias]

    def state(self) -> np.ndarray:
        """All parameters and what the optimiser keeps of each, as one row."""
        return np.concatenate([x.ravel() for xs in (self.parameters(), *self.moments) for x in xs])

    def restore(self, state: np.ndarray) -> LogBilinear:
        at = 0
        for xs in (self.parameters(), *self.moments):
            for x in xs:
                x[...] = state[at : at + x.size].reshape(x.shape)
                at += x.size
        return self

    def fit(self, contexts: np.ndarray, counts: np.ndarray, unigram: np.ndarray, epochs: int = EPOCHS, noise: int = NOISE, rate: float = 0.03) -> LogBilinear:
        """counts: a row for each context, of how often each class follows it."""
        if len(contexts):
            self.bias[:] = np.log(unigram)
            for epoch in range(epochs):
                self.take(contexts, counts, unigram, np.full(len(contexts), float(PRIOR)), (len(contexts), counts.sum(dtype=float) + PRIOR * len(contexts)), epoch, epochs, noise, rate)
        return self

    def take(self, contexts: np.ndarray, counts: np.ndarray, unigram: np.ndarray, prior: np.ndarray, whole: tuple[int, float], epoch: int, epochs: int = EPOCHS, noise: int = NOISE, rate: float = 0.03, shard: int = 0) -> LogBilinear:
        """One epoch over contexts that are part of a whole: the number of all rows, and of all that follows them with the priors (one for each row).

        Scores and gradients are of single precision, parameters and moments of double.
        """
        (number, total), single = whole, np.float32
        unigram, prior = unigram.astype(single), prior.astype(single)[:, None]
        shift, params, (m, v) = np.log(noise * unigram), self.parameters(), self.moments
        order = np.random.default_rng((2, epoch, shard)).permutation(len(contexts))
        each = -(-len(order) // BATCH)
        steps, t = epochs * each, epoch * each
        for at in range(0, len(order), BATCH):
            own, t = order[at : at + BATCH], t + 1
            c, n = contexts[own], counts[own] + prior[own] * unigram  # what a context that is seldom seen falls back to
            scale = single(number / (len(own) * total))
            turn, target = self.turn.astype(single), self.target.astype(single)
            r = [self.context[c[:, i]].astype(single) for i in range(CONTEXT)]
            moved = sum(r[i] @ turn[i] for i in range(CONTEXT))
            odds = 1 / (1 + np.exp(-(moved @ target.T + (self.bias.astype(single) - shift))))
            d = (n * (1 - odds) - noise * n.sum(1, keepdims=True) * unigram * odds) * scale
            back = d @ target
            into = np.zeros_like(self.context)
            for i in range(CONTEXT):
                np.add.at(into, c[:, i], back @ turn[i].T)
            grads = [into, np.stack([x.T @ back for x in r]), d.T @ moved, d.sum(0)]
            for i, (p, x) in enumerate(zip(params, grads, strict=True)):
                x = x.astype(float)
                m[i] += 0.1 * (x - m[i])
                v[i] += 0.01 * (x * x - v[i])
                p += rate * (1 - t / steps) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-10)
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place the scores of all classes after each class, the nearest place with the biases, and the
        logarithm of the sum of exponentials for each context: places x classes x classes, and classes x classes."""
        score = np.stack([(self.context @ t) @ self.target.T for t in self.turn])
        score[-1] += self.bias
        # exp of a sum of scores is a product, so that one matrix product gives the sums for all contexts
        top = score.max(axis=2)
        total = np.exp(score[0] - top[0][:, None]) @ np.exp(score[1] - top[1][:, None]).T
        return score, np.log(total) + top[0][:, None] + top[1][None, :]

    def log_probabilities(self, contexts: np.ndarray) -> np.ndarray:
        """log10 P(class | context), a row for each context; each row's probabilities sum to 1."""
        s = sum(self.context[contexts[:, i]] @ self.turn[i] for i in range(CONTEXT)) @ self.target.T + self.bias
        s -= s.max(axis=1, keepdims=True)
        return (s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / np.log(10)


def followers(docs: DataFrame, shared, classes: int, text: str = "text") -> DataFrame:
    """(context, class, n) over all texts, each begun by ends and ended by one; settled. context: its classes as one number."""

    def run(batches):
        known = shared.value
        cells, n, held, size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merged():
            """What is held, with what was counted before."""
            new = np.concatenate(held)
            new.sort()
            edge = np.flatnonzero(np.diff(new, prepend=-1))
            every, times = np.concatenate([cells, new[edge]]), np.concatenate([n, np.diff(np.append(edge, len(new)))])
            order = np.argsort(every, kind="stable")
            every, times = every[order], times[order]
            edge = np.flatnonzero(np.diff(every, prepend=-1))
            return every[edge], np.add.reduceat(times, edge)

        def out():
            for at in range(0, len(cells), 50_000):
                part = cells[at : at + 50_000]
                yield pa.record_batch([pa.array(part // classes), pa.array((part % classes).astype(np.int32)), pa.array(n[at : at + 50_000])], names=["context", "class", "n"])

        for batch in batches:
            for x in batch.column(0).to_pylist():
                ids = _class_ids(lower_words_of(x), known)
                held.append((ids[:-2] * classes + ids[1:-1]) * classes + ids[2:])
                size += len(ids)
                if size > 1_000_000:
                    cells, n = merged()
                    held, size = [], 0
                    if len(cells) > 4_000_000:
                        yield from out()
                        cells, n = np.empty(0, np.int64), np.empty(0, np.int64)
        if held:
            cells, n = merged()
        yield from out()

    return settle(docs.select(F.col(text).alias("text")).mapInArrow(run, "context long, class int, n long").groupBy("context", "class").agg(F.sum("n").alias("n")))


def dealt(found: DataFrame, classes: int, shards: int) -> RDD:
    """Followers by shard: (shard, contexts, row of each cell, its class, its count), one element for each shard that has any."""

    def pack(batches):
        held, size = [], 0

        def out():
            context, now, n = (np.concatenate([h[i] for h in held]) for i in range(3))
            shard = mix(context.astype(np.uint64)) % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            cells, n, edge = (context * classes + now)[order], n.astype(np.float32)[order], np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
            full = [i for i in range(shards) if edge[i] < edge[i + 1]]
            yield pa.record_batch([pa.array(full, pa.int32()), *(pa.array([x[edge[i] : edge[i + 1]].tobytes() for i in full], pa.binary()) for x in (cells, n))], names=["shard", "cells", "n"])

        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(3)])
            size += batch.num_rows
            if size > 500_000:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    def whole(shard, parts):
        parts = [p for _, p in parts]
        if parts:
            cells, n = np.concatenate([np.frombuffer(p[0], np.int64) for p in parts]), np.concatenate([np.frombuffer(p[1], np.float32) for p in parts])
            order = np.argsort(cells)
            contexts, row = np.unique(cells[order] // classes, return_inverse=True)
            yield shard, contexts, row.astype(np.int32), (cells[order] % classes).astype(np.int32), n[order]

    rows = found.select("context", "class", "n").mapInArrow(pack, "shard int, cells binary, n binary").rdd.map(lambda r: (r.shard, (bytes(r.cells), bytes(r.n))))
    return rows.partitionBy(shards, int).mapPartitionsWithIndex(whole)


def train(learn: DataFrame, shared, classes: int, text: str = "text", contexts: int = CONTEXTS) -> LogBilinear:
    """The model of all that follows all contexts; contexts: of a shard.

    To the driver come the models of `classes` ** CONTEXT / `contexts` shards at most, once an epoch, and `classes` counts each of
    the contexts that all shards share, an eighth of a shard's.
    """
    sc = learn.sparkSession.sparkContext
    found = followers(learn, shared, classes, text)
    seen = np.zeros(classes)
    for r in found.groupBy("class").agg(F.sum("n").alias("n")).collect():  # `classes` rows at most
        seen[r["class"]] = r["n"]
    totals = settle(found.groupBy("context").agg(F.sum("n").alias("n")).withColumnRenamed("context", "word"))
    number = totals.count()
    if not number:
        return LogBilinear(classes)
    parts = -(-number // contexts)
    top = np.array(sorted(r.word for r in most_frequent(totals, contexts // 8)) if parts > 1 else [], np.int64)
    often = learn.sparkSession.createDataFrame([(int(c), i) for i, c in enumerate(top)], "context long, row int")
    rows = found.join(F.broadcast(often), "context").select("row", "class", F.col("n").cast("float").alias("n")).toArrow()
    shared_counts = np.zeros((len(top), classes), np.float32)
    shared_counts[rows["row"].to_numpy(), rows["class"].to_numpy()] = rows["n"].to_numpy() / parts
    model, unigram = LogBilinear(classes), (seen + 0.5) / (seen + 0.5).sum()
    model.bias[:] = np.log(unigram)
    prior = PRIOR * min(1.0, contexts / number)
    total, every = seen.sum() + prior * number, sc.broadcast((top, shared_counts))
    shards = dealt(found.join(F.broadcast(often), "context", "left_anti"), classes, parts).persist(StorageLevel.DISK_ONLY)
    for epoch in range(EPOCHS):
        start = sc.broadcast(model.state())

        def take(shard, start=start, epoch=epoch):
            (at, own, row, now, n), (top, first) = shard, every.value
            counts = np.concatenate([first, np.zeros((len(own), classes), np.float32)])
            counts[len(top) + row, now] = n
            own = np.concatenate([top, own])
            priors = np.full(len(own), prior)
            priors[: len(top)] /= parts
            pairs = np.stack([own // classes, own % classes], axis=1)
            return LogBilinear(classes).restore(start.value).take(pairs, counts, unigram, priors, (len(own) * parts, total), epoch, shard=at).state()

        model.restore(np.mean(shards.map(take).collect(), axis=0))  # in the shards' order
        start.destroy()
    shards.unpersist()
    return model


def _class_ids(words: list[bytes], known: dict[bytes, tuple]) -> np.ndarray:
    none = (0, OTHER)
    ids = np.fromiter((known.get(w, none)[1] for w in words), np.int64, len(words))
    return np.concatenate([[END] * CONTEXT, ids, [END]])


def vocabulary(learn: DataFrame, classes: int, frequent: int, text: str = "text") -> tuple[DataFrame, list, dict[bytes, tuple[int, int]]]:
    """Counts of all words (settled), the `frequent` most frequent ones, and for these (count, class)."""
    counts = settle(word_counts(learn, text))
    top = most_frequent(counts, frequent)
    return counts, top, {bytes(r.word): (r.n, i + 2 if i < classes - 2 else OTHER) for i, r in enumerate(top)}


def score(docs: DataFrame, learn: DataFrame, held_out, key: str = "doc_id", text: str = "text", classes: int = CLASSES, frequent: int = FREQUENT) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs; learn: training rows."""
    spark = docs.sparkSession
    ship(spark)
    counts, top, known = vocabulary(learn, classes, frequent, text)
    ends = learn.count()
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = total + ends, distinct + bool(ends)
    shared = spark.sparkContext.broadcast(known)  # `frequent` words at most
    model = train(learn, shared, classes, text)
    table = spark.sparkContext.broadcast(model.tables())  # (CONTEXT + 1) x classes x classes
    named = sum(r.n for r in top[: classes - 2])
    others, other_words = total - ends - named, distinct - bool(ends) - min(len(top), classes - 2)
    base_unit, other_unit = np.log10(total + 0.5 * (distinct + 1)), np.log10(others + 0.5 * (other_words + 1))
    end_log = float(np.log10(ends + 0.5))
    names = "uid long, doc long, held_out boolean, n_tokens long, n_known long, log_sum double, other_sum double, path double, n_other long, word binary, times long"
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.int64())

    def run(batches):
        from pyspark import TaskContext

        known, (places, sums) = shared.value, table.value
        own = {w: (c, i, float(np.log10(c + 0.5))) for w, (c, i) in known.items()}
        uid = TaskContext.get().partitionId() << 33
        none = (0, OTHER, 0.0)
        for batch in batches:
            for at in range(0, batch.num_rows, 300):
                rows = []
                for doc, held, x in zip(*(c.to_pylist() for c in batch.slice(at, 300).columns), strict=True):
                    words = lower_words_of(x)
                    got = [own.get(w, none) for w in words]
                    ids = np.fromiter((g[1] for g in got), np.int64, len(got))
                    log = np.fromiter((g[2] for g in got), np.float64, len(got))
                    seen = np.fromiter((g[0] for g in got), np.int64, len(got)) > 0
                    around = np.concatenate([[END] * CONTEXT, ids, [END]])
                    far, near, now = around[:-2], around[1:-1], around[2:]
                    path = (places[0][far, now] + places[1][near, now] - sums[far, near]).sum() / np.log(10)
                    other = (ids == OTHER) & seen
                    rare = Counter(w for w, s in zip(words, seen.tolist(), strict=True) if not s)
                    rows.append((uid, doc, held, len(words) + 1, int(seen.sum()) + (ends > 0), float(log.sum()) + end_log, float(log[other].sum()), float(path), int((ids == OTHER).sum()), None, None))
                    rows += [(uid, None, None, None, None, None, None, None, None, w, n) for w, n in rare.items()]
                    uid += 1
                yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[n.split()[0] for n in names.split(", ")])

    # written once, so that a row's uid is the same for both readers below
    found = settle(docs.select(F.col(key).cast("long").alias("doc"), held_out.alias("held_out"), F.col(text).alias("text")).mapInArrow(run, names))
    rare = found.where("word is not null").select("uid", "word", "times").join(counts, "word", "left").groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_sum"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"))
    whole = found.where("word is null").drop("word", "times").join(rare, "uid", "left").fillna(0, ["rare_sum", "rare_known"])
    return whole.select(
        F.col("doc").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.col("rare_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_sum") + F.col("rare_sum") - F.col("n_tokens") * F.lit(float(base_unit))).alias("base_score"),
        (F.col("path") + F.col("other_sum") + F.col("rare_sum") - F.col("n_other") * F.lit(float(other_unit))).alias("score"),
    )
