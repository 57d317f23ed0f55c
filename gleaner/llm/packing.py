"""Packing as a cutting-stock problem solved by column generation.

Documents become pieces: full sequences, and a rest. A histogram of piece lengths, in classes of `grain`
tokens, is what the linear program sees: how often to use each pattern (a multiset of classes that fits a
sequence) so that all pieces are placed in as few sequences as possible. New patterns are priced by a
knapsack dynamic program over the duals until none improves. The rounded-down pattern counts and a
first-fit plan for the few pieces left give ranges of ranks; pieces are ranked in their class over all
partitions, and a piece's rank tells its sequence. Driver and broadcasts hold the histogram and the plan
only: at most SEQUENCE / grain classes, whatever the corpus is.

Defined cases: null or empty text has the end id alone; a repeated row is packed each time; texts of any
length are cut; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import once, settle, ship, trim

SEQUENCE = 2048
GRAIN = 8
END_ID = 1


#: Fixed value: the pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Blanks in a row from which on a text goes to the library: well below what tiktoken's pattern can step back over.
LONG_BLANK = 20_000


class TextIds:
    """ids as tokenizers gives them, from the text of the vocabulary's file.

    Where the file is a plain byte-level one whose ids follow the order of its merges, tiktoken gives the same
    ids from the same merges (tested on every code point). Texts with a special token's string or a run of blanks
    that its pattern could not step back over, and all texts of other files, go to the library.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core's work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)").search
        self.blank = re.compile(rf"\s{{{LONG_BLANK}}}").search
        self.plain = _by_ranks(spec)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.plain and not self.special(text) and (len(text) < LONG_BLANK or not self.blank(text)):
            return array("I", self.plain(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def _by_ranks(spec: str):
    """tiktoken's encoding of ordinary text, if the file says just what that does; else None."""
    import tiktoken

    spec = json.loads(spec)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    raw = {s: bytes([i]) for i, s in enumerate(byte_symbols())}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {b"".join(raw[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in pairs]
    if len(ranks) != 256 + len(order) or order != sorted(order) or max(ranks[raw[s]] for s in raw) > order[0]:
        return None
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens) of every piece: full sequences and a rest. `path` is read by the driver."""
    spark = docs.sparkSession
    ship(spark)
    names = [key, "start", "length", "ids_crc32", "doc_tokens"]
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a vocabulary's size

    def run(batches):
        ids_of = once("text_ids", spec.value, TextIds)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part, rows = batch.slice(at, 400), []
                for doc, x in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    ids = ids_of(x) + end
                    n = len(ids) // 4
                    rows += [(doc, s, min(sequence, n - s), zlib.crc32(ids[4 * s : 4 * (s + sequence)]), n) for s in range(0, n, sequence)]
                yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=names)
        trim()

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


# -- the linear program -------------------------------------------------------------------


def best_pattern(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items 1..len(value) with total size <= capacity: unbounded knapsack."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        k = min(c, len(value))
        gain = best[c - k : c][::-1] + value[:k]
        i = int(np.argmax(gain))
        if gain[i] > best[c - 1] + 1e-12:
            best[c], took[c] = gain[i], i + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(value), int), capacity
    while c > 0:
        if took[c]:
            pattern[took[c] - 1] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def inverse_of(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with the largest pivot; element by element, as threads of a BLAS can wait for those of the JVM."""
    n = len(a)
    m = np.hstack([a, np.eye(n)])
    for i in range(n):
        k = i + int(np.argmax(np.abs(m[i:, i])))
        m[[i, k]] = m[[k, i]]
        m[i] /= m[i, i]
        rest = m[:, i].copy()
        rest[i] = 0
        m -= rest[:, None] * m[i]
    return m[:, n:]


def solve(demand: np.ndarray, capacity: int, rounds: int = 40_000) -> tuple[list[np.ndarray], np.ndarray]:
    """Patterns and how often to use each (real numbers): revised simplex with priced columns.

    demand[i]: pieces of size i + 1. At the start each class has a pattern of its own; the basis stays
    square. Stops when no pattern is worth more than a sequence.
    """
    classes = np.flatnonzero(demand)
    if not len(classes):
        return [], np.empty(0)
    # the added crumbs keep steps of the simplex method from being of length zero
    sizes, need = classes + 1, demand[classes] + np.random.default_rng(0).uniform(0.001, 0.01, len(classes))
    basis = [np.where(np.arange(len(classes)) == i, capacity // s, 0) for i, s in enumerate(sizes)]
    inverse = np.diag([1 / (capacity // s) for s in sizes])
    use = np.einsum("ij,j->i", inverse, need)
    value = np.zeros(int(sizes.max()))
    for turn in range(rounds):
        if turn and turn % 4000 == 0:  # against rounding errors
            inverse = inverse_of(np.array(basis, float).T)
            use = np.maximum(np.einsum("ij,j->i", inverse, need), 0)
        value[:] = 0
        value[classes] = inverse.sum(axis=0)  # the duals: every sequence costs one
        worth, pattern = best_pattern(np.maximum(value, 0), capacity)
        if worth <= 1 + 1e-7:
            break
        column = pattern[classes]
        d = np.einsum("ij,j->i", inverse, column)  # not BLAS: its threads would wait for Spark's
        if not (d > 1e-9).any():
            break
        ratio = np.where(d > 1e-9, use / np.where(d > 1e-9, d, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        use -= step * d
        use[out] = step
        inverse[out] /= d[out]
        rest = d.copy()
        rest[out] = 0
        inverse -= np.outer(rest, inverse[out])
        basis[out] = column
    full = []
    for b in basis:
        p = np.zeros(len(demand), int)
        p[classes] = b
        full.append(p)
    return full, np.maximum(use, 0)


def plan(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that place exactly `demand`: rounded patterns, then first-fit for what is left."""
    patterns, use = solve(demand, capacity)
    left, out = demand.astype(int).copy(), []
    for p, x in zip(patterns, use, strict=True):
        if (times := int(np.floor(x + 1e-9))) > 0 and p.any():
            times = min([times, *(int(left[i] // p[i]) for i in np.flatnonzero(p))])
            if times:
                out.append((p, times))
                left = left - times * p
    bins: list[list] = []  # [room, pattern]
    for i in np.flatnonzero(left)[::-1]:
        per = capacity // (i + 1)
        many = left[i] // per if left[i] > 4 * per * 64 else 0  # only if the program stopped early
        if many:
            p = np.zeros(len(demand), int)
            p[i] = per
            out.append((p, int(many)))
        for _ in range(left[i] - many * per):
            for b in bins:
                if b[0] >= i + 1:
                    break
            else:
                bins.append(b := [capacity, np.zeros(len(demand), int)])
            b[0] -= i + 1
            b[1][i] += 1
    return out + [(b[1], 1) for b in bins]


def ranges(steps: list[tuple[np.ndarray, int]]) -> dict[int, np.ndarray]:
    """For each class, rows (first rank, first sequence, pieces in each sequence) in order of rank."""
    found: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for p, times in steps:
        for i in np.flatnonzero(p):
            found.setdefault(int(i), []).append((taken.get(i, 0), sequence, int(p[i])))
            taken[i] = taken.get(i, 0) + times * int(p[i])
        sequence += times
    return {i: np.array(r, np.int64) for i, r in found.items()}


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, grain: int = GRAIN) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    capacity = sequence // grain
    names = [key, "start", "length", "ids_crc32", "doc_tokens"]  # rows that tie in all of these are equal
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a third of all pieces may be of one class: ranks are counted by class and salt, then shifted. Salts are written with
    # the pieces and come from where they lie, so that rows without an id, and equal ones, are dealt too
    cut = settle(pieces(docs, path, key, text, sequence).withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts))))
    dealt = cut.withColumn("_class", F.expr(f"cast((length + {grain - 1}) div {grain} - 1 as int)"))
    counts = settle(dealt.groupBy("_class", "_salt").agg(F.count("*").alias("_n")).coalesce(8))  # capacity * salts rows at most
    demand = np.zeros(capacity, np.int64)
    for r in counts.groupBy("_class").agg(F.sum("_n").alias("n")).collect():  # a row for each class: `capacity` at most
        demand[r["_class"]] = r["n"]
    shared = spark.sparkContext.broadcast(ranges(plan(demand, capacity)))
    shift = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_class").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = dealt.withColumn("_row", F.row_number().over(Window.partitionBy("_class", "_salt").orderBy(*names)) - 1).join(shift, ["_class", "_salt"])

    def place(batches):
        plans = shared.value
        for batch in batches:
            kind, rank = (batch.column(i).to_numpy() for i in (5, 6))
            target = np.zeros(len(kind), np.int64)
            for c in np.unique(kind):
                own, r = kind == c, plans[int(c)]
                at = np.searchsorted(r[:, 0], rank[own], side="right") - 1
                target[own] = r[at, 1] + (rank[own] - r[at, 0]) // r[at, 2]
            yield pa.record_batch([*batch.columns[:5], pa.array(target)], names=[*names, "sequence_id"])

    placed = ranked.select(*names, "_class", (F.col("_row") + F.col("_before")).alias("_rank")).mapInArrow(place, ", ".join(f"{n} long" for n in [*names, "sequence_id"]))
    # a sequence holds `sequence` pieces at most, so this window's groups are bounded
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *names).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))
