"""Mixing sources to target weights: exact quotas of blocks, split among shards by a multivariate hypergeometric tree.

Each source's documents lie in an order of hashes, end to end, and are cut in blocks of words; a source is taken
from the start, over and over, each time with its blocks permuted anew, until its target is reached to the word.
The quotas (blocks of each source) are split among the output shards by a binary tree: a node's blocks go to its two
halves by a draw without replacement, seeded by the node, so that any task can walk from the root to its own shards.
A shard's share of a source is a run of the source's permuted places, disjoint from all others', and its blocks are
shuffled within the shard.

Defined cases: a null or blank text has no words, is in no block and takes nothing; a null source is the last one;
repeated rows stand for themselves, equal ones (also without id) lie behind one another; of sources without words
nothing is taken; an empty table gives no rows. Extra columns are left out, whatever their names. Reruns agree: all
order comes from the rows' contents and the seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix as scrambled
from .common import settle, ship

#: Weights by the order of sources, repeating, and how often a source may be taken.
WEIGHTS = (5, 2, 1)
REPEATS = 3

BLOCK_WORDS = 1024
SHARD_WORDS = 1 << 20
#: numpy draws from populations below 10^9: beyond so many blocks, blocks are longer.
MOST_BLOCKS = 500_000_000
#: Sources come to the driver, one row each; more are an error.
MOST_SOURCES = 100_000
#: Rows of one window while documents are laid out.
BAND_ROWS = 4_000

TAKEN = "source_no int, block long, copy int, shard long, place int, words long"


def shares(sizes: list[int], weights: list[int], most: int = REPEATS) -> list[Fraction]:
    """Targets that share the sum of sizes by weight; none is above `most` times its size, the excess goes to the others."""
    left, open_, out = Fraction(sum(sizes)), list(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        for i in full or open_:
            out[i] = Fraction(most * sizes[i]) if full else unit * weights[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)] if full else []
    return out


def _round(place: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """One pass of a four-round Feistel network over the smallest even number of bits that holds n."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    a, b = place >> half, place & low
    for i in range(4):
        k = np.uint64((key * 0x9E3779B97F4A7C15 + (3 - i if back else i)) % 2**64)
        a, b = (b ^ (scrambled(a + k) & low), a) if back else (b, a ^ (scrambled(b + k) & low))
    return a << half | b


def permuted(places, n: int, key: int, back: bool = False) -> np.ndarray:
    """Where a keyed permutation of range(n) takes these places (or, back, where they came from): walks until it is within n."""
    out = _round(np.asarray(places, np.uint64), n, key, back)
    while (off := np.flatnonzero(out >= n)).size:
        out[off] = _round(out[off], n, key, back)
    return out.astype(np.int64)


@dataclass
class Source:
    """words it has, its target, and what follows: blocks, quota of blocks, and the words of the last one that is taken."""

    words: int
    target: Fraction
    block: int
    key: int
    blocks: int = field(init=False)
    quota: int = field(init=False)
    cut: int = field(init=False)

    def __post_init__(self):
        self.blocks = -(-self.words // self.block)
        whole, rest = divmod(round(self.target), self.words) if self.words else (0, 0)
        n, self.cut = 0, self.block
        if rest:
            # all blocks are equal but the last, which is shorter and lies somewhere in this round's order
            short = self.words - (self.blocks - 1) * self.block
            at = int(permuted([self.blocks - 1], self.blocks, self.copy_key(whole), back=True)[0])
            words = lambda k: k * self.block - (self.block - short) * (at < k)  # noqa: E731  of the first k
            n = -(-rest // self.block)
            n += words(n) < rest
            self.cut = rest - words(n - 1)
        self.quota = whole * self.blocks + n

    def copy_key(self, copy: int) -> int:
        return self.key * (REPEATS + 1) + copy

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, copy, words) at these places of the source's quota."""
        copies = places // self.blocks
        out = np.empty(len(places), np.int64)
        for c in np.unique(copies):
            here = copies == c
            out[here] = permuted(places[here] - c * self.blocks, self.blocks, self.copy_key(int(c)))
        words = np.where(out == self.blocks - 1, self.words - (self.blocks - 1) * self.block, self.block)
        return out, copies, np.where(places == self.quota - 1, np.minimum(words, self.cut), words)


@dataclass
class Tree:
    """Splits quotas (a number of blocks for each source) among shards."""

    quotas: np.ndarray
    shards: int
    seed: int

    def halves(self, first: int, shards: int, quotas: np.ndarray, starts: np.ndarray):
        """The two halves of a node: (first shard, shards, quotas, where each source's run starts)."""
        left = shards // 2
        total = int(quotas.sum())
        n = total * left // shards
        drawn = np.random.default_rng([self.seed, first, shards]).multivariate_hypergeometric(quotas, n, method="marginals") if total else quotas
        return (first, left, drawn, starts), (first + left, shards - left, quotas - drawn, starts + drawn)

    def leaves(self, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, quotas, starts) of shards low to high - 1; only nodes that hold one of them are drawn."""
        nodes = [(0, self.shards, self.quotas, np.zeros_like(self.quotas))]
        while nodes:
            first, n, quotas, starts = nodes.pop()
            if first >= high or first + n <= low:
                continue
            if n == 1:
                yield first, quotas, starts
            else:
                a, b = self.halves(first, n, quotas, starts)
                nodes += [b, a]


def _rows(sources: list[Source], tree: Tree, low: int, high: int):
    """The blocks of shards low to high - 1, as columns, shard by shard: drawn from each source's run, then shuffled."""
    for shard, quotas, starts in tree.leaves(low, high):
        parts = []
        for no in np.flatnonzero(quotas):
            block, copy, words = sources[no].at(np.arange(starts[no], starts[no] + quotas[no]))
            parts.append((np.full(len(block), no), block, copy, words))
        if not parts:
            continue
        no, block, copy, words = (np.concatenate(x) for x in zip(*parts, strict=True))
        place = np.random.default_rng([tree.seed, 1, shard]).permutation(len(no))
        yield {"source_no": no, "block": block, "copy": copy, "shard": np.full(len(no), shard), "place": place, "words": words}


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(source, doc_id, text_hash, size, n): equal rows once, counted before they are shuffled."""
    text = F.col(text_col).cast("string")
    size = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), size.alias("size"))
    return rows.groupBy("source", "doc_id", "text_hash", "size").agg(F.count("*").alias("n"))


def layout(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, list]:
    """Settled (source, doc_id, text_hash, size, n, begin): where the words of n equal rows begin in their source; and the sources' totals."""
    rows = settle(_sizes(docs, id_col, text_col, source_col))
    totals = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.count("*").alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    bands = max(1, -(-max((r["rows"] for r in totals), default=1) // BAND_ROWS))
    h = F.xxhash64("doc_id", "text_hash", "size")
    rows = rows.withColumn("_h", h).withColumn("_band", F.pmod(F.shiftrightunsigned("_h", 33), F.lit(bands)))
    before = Window.partitionBy("source").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "_band").agg(F.sum(F.col("size") * F.col("n")).alias("_words")).select("source", "_band", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("source", "_band").orderBy("_h", "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_own", F.coalesce(F.sum(F.col("size") * F.col("n")).over(within), F.lit(0)))
    on = placed["source"].eqNullSafe(sums["source"]) & (placed["_band"] == sums["_band"])
    return settle(placed.join(sums, on).select(placed["source"], "doc_id", "text_hash", "size", "n", (F.col("_before") + F.col("_own")).alias("begin"))), totals


def mix(docs: DataFrame, block: int = BLOCK_WORDS, shard: int = SHARD_WORDS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every row of docs with what the mix takes of it: one row for each run of its words in a block of a shard.

    Columns: source, source_no, doc_id, text_hash, size, source_size, target, row_begin (where the row's words begin in
    its source: with source_no, the row's key where it has words), start and length (words of the text), copy, shard and
    place (of the block in its shard). Rows with nulls for start to place take nothing; each row of docs has one at least.
    """
    spark = docs.sparkSession
    ship(spark)
    rows, totals = layout(docs, id_col, text_col, source_col)
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(totals))]
    targets = shares([r["words"] for r in totals], weights)
    block = max(block, -(-REPEATS * sum(r["words"] for r in totals) // MOST_BLOCKS))
    sources = [Source(r["words"], t, block, i + seed * MOST_SOURCES) for i, (r, t) in enumerate(zip(totals, targets, strict=True))]
    quotas = np.array([s.quota for s in sources], np.int64)
    tree = Tree(quotas, max(1, -(-int(quotas.sum()) * block // shard)), seed)

    tasks = min(tree.shards, max(1, int(quotas.sum()) // 20_000), 10_000)

    def drawn(batches):
        import pyarrow as pa

        for batch in batches:
            for task in batch.column(0).to_pylist():
                for columns in _rows(sources, tree, tree.shards * task // tasks, tree.shards * (task + 1) // tasks):
                    types = {"source_no": pa.int32(), "copy": pa.int32(), "place": pa.int32()}
                    yield pa.RecordBatch.from_pydict({k: pa.array(v, types.get(k, pa.int64())) for k, v in columns.items()})

    taken = settle(spark.range(0, tasks, 1, tasks).mapInArrow(drawn, TAKEN))  # the plan of the shards; as files its size is known
    facts = spark.createDataFrame([(r["source"], i, r["words"], float(t)) for i, (r, t) in enumerate(zip(totals, targets, strict=True))], "_source string, source_no int, source_size long, target double")
    rows = rows.join(F.broadcast(facts), rows["source"].eqNullSafe(F.col("_source"))).drop("_source")  # MOST_SOURCES rows
    # equal rows become rows again, in slices so that no task makes them all
    many = rows.withColumn("_slice", F.explode(F.expr("sequence(0L, (n - 1) div 1000)"))).repartition("source_no", "begin", "_slice")
    each = many.withColumn("_i", F.explode(F.expr("sequence(_slice * 1000, least(_slice * 1000 + 999, n - 1))"))).withColumn("row_begin", F.col("begin") + F.col("_i") * F.col("size"))
    size = F.lit(block)
    # rows without words meet no block: they are dealt by numbers below those of blocks
    none = F.array(-1 - F.pmod(F.xxhash64("doc_id", "_i"), F.lit(1 << 20)))
    touched = F.when(F.col("size") > 0, F.expr(f"sequence(row_begin div {block}, (row_begin + size - 1) div {block})")).otherwise(none)
    runs = each.withColumn("block", F.explode(touched)).join(taken, ["source_no", "block"], "left")
    start = F.greatest(F.col("block") * size - F.col("row_begin"), F.lit(0))
    length = F.least(F.col("block") * size + F.col("words") - F.col("row_begin"), F.col("size")) - start
    runs = runs.withColumn("start", start).withColumn("length", length)
    has = F.col("words").isNotNull() & (F.col("length") > 0)  # least() passes over null
    kept = [F.when(has, F.col(c)).alias(c) for c in ("start", "length", "copy", "shard", "place")]
    return runs.select("source", "source_no", "doc_id", "text_hash", "size", "source_size", "target", "row_begin", "_i", *kept)


def taken_words(docs: DataFrame, **how) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken (words, repeats counted) and shards it is in."""
    of = ["source_no", "row_begin", "_i", "doc_id", "text_hash", "size", "source_size", "target"]
    sums = mix(docs, **how).groupBy(*of).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("taken"), F.count_distinct("shard").alias("shards"))
    return sums.select("doc_id", "size", "source_size", "target", "taken", "shards")


def shard_texts(docs: DataFrame, runs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(shard, place, doc_id, text) in the order of shards: the words that mix() took, of the texts they come from.

    Equal rows share their text: it is looked up by (source, doc_id, hash of the text). A run's words are cut out by
    Spark before rows are dealt by shard; a shard's blocks, and its partition, are bounded by the shard's size.
    """
    text = F.col(text_col).cast("string")
    once = docs.select(F.col(source_col).cast("string").alias("_s"), F.col(id_col).cast("long").alias("_d"), F.xxhash64(text).alias("_h"), text.alias("_t")).dropDuplicates(["_s", "_d", "_h"])
    runs = runs.where("length > 0")
    found = runs.join(once, runs["source"].eqNullSafe(F.col("_s")) & runs["doc_id"].eqNullSafe(F.col("_d")) & (runs["text_hash"] == F.col("_h")))
    words = F.regexp_extract_all("_t", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cut = found.select("shard", "place", "source", "doc_id", "row_begin", F.array_join(F.slice(words, (F.col("start") + 1).cast("int"), F.col("length").cast("int")), " ").alias("text"))
    return cut.repartitionByRange("shard").sortWithinPartitions("shard", "place", "row_begin")
