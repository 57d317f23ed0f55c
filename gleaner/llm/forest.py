"""Approximate nearest neighbours in a forest of random-projection trees.

Each tree halves space by random directions at the medians of a bounded sample (FIT_ROWS), down to leaves of
about LEAF rows; every row is put in a leaf of each tree. A query walks all trees through one shared
priority queue, in order of the squared distance that its path has gone to the wrong side of splits, until it
has PROBES of all leaves. Candidates of these leaves are ranked by exact distance in double precision.

The share of leaves that is probed is a parameter, as recall depends on it: on vectors without structure
(64 independent components) no tree prunes well, and 0.35 of the leaves of 4 trees are what 0.95 takes at 1,000
to 4,000 rows. Tables below about 1,000 rows have so few leaves that two for each tree are more; none gets less.

Scale: equal vectors are one class, of which only the `k + 1` smallest ids can be among the nearest. Rows lie in blocks
of leaves, of BLOCK_ROWS on average; trees are MOST_DEPTH deep at most, and leaves that outgrow a block are parted by a
hash. For each block only the queries that probe it come there, and are streamed behind its rows, so a task holds one
block's rows and a batch of queries; it sends `k` rows for each query, not one for each pair.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components neither ask nor are
found; vectors of other lengths than the most frequent one take no part; null ids take no part; a repeated id
is one row if its vector is the same; fewer candidates than `k` are all returned; ties go to the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, settle, ship

TREES = 4
LEAF = 192
PROBES = 0.35
FIT_ROWS = 20_000
MOST_DEPTH = 12
#: Rows that a block of leaves is meant to hold.
BLOCK_ROWS = 8192


def fine(v: Column) -> Column:
    """Whether a vector (array<double>) takes part; null for null."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, v array<double>, *extra) of rows that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("v"), *extra)
    return rows.where(F.col(key).isNotNull() & v.isNotNull()).where(fine(v))


class Forest:
    """Directions and thresholds of all trees, in heap order."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 7):
        g = np.random.default_rng(seed)
        self.depth, n = depth, 2**depth - 1
        self.directions = g.normal(size=(trees, n, sample.shape[1]))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.cuts = np.zeros((trees, n))
        for t in range(trees):
            todo = [(0, sample)]
            while todo:
                node, own = todo.pop()
                if node >= n or not len(own):
                    continue
                p = own @ self.directions[t, node]
                self.cuts[t, node] = np.median(p)
                right = p > self.cuts[t, node]
                todo += [(2 * node + 1, own[~right]), (2 * node + 2, own[right])]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, rows x trees."""
        out = np.zeros((len(x), len(self.cuts)), np.int64)
        for t in range(len(self.cuts)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                p = np.einsum("ij,ij->i", x, self.directions[t][node])
                node = 2 * node + 1 + (p > self.cuts[t][node])
            out[:, t] = node - (2**self.depth - 1)
        return out

    def probe(self, q: np.ndarray, most: int) -> list[tuple[int, int]]:
        """The first `most` (tree, leaf) for a query, by one queue over all trees."""
        n = 2**self.depth - 1
        side = np.einsum("tnd,d->tn", self.directions, q) - self.cuts
        queue, found = [(0.0, t, 0) for t in range(len(self.cuts))], []
        while queue and len(found) < most:
            gone, t, node = heapq.heappop(queue)
            while node < n:
                s = side[t, node]
                near = 2 * node + 1 + (s > 0)
                heapq.heappush(queue, (gone + s * s, t, 4 * node + 3 - near))
                node = near
            found.append((t, node - n))
        return found


def nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, distance) of the k nearest of x for each q, without equal ids; by exact differences."""
    # the product form finds who may be among the nearest, differences give the distances
    rough = (q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * q @ x.T
    rough[qids[:, None] == ids] = np.inf
    keep = min(len(ids), k)
    out = []
    for i in range(len(q)):
        limit = np.partition(rough[i], keep - 1)[keep - 1]
        if not np.isfinite(limit):
            limit = np.finfo(float).max
        near = np.flatnonzero((rough[i] <= limit + 1e-9 * (1 + abs(limit))) & (ids != qids[i]))  # the bound may be infinite
        d = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
        best = np.lexsort((ids[near], d))[:k]
        out.append((np.full(len(best), i), ids[near][best], d[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2 + (np.empty(0),)


def search(vectors: DataFrame, every: int = 100, k: int = 10, key: str = "vec_id", vector: str = "embedding", trees: int = TREES, probes: float = PROBES, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score): of rows whose id is divisible by `every`, the nearest found among all others."""
    spark = vectors.sparkSession
    ship(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable(vectors, key, vector).select(F.col(key).alias("id"), "v")
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return empty
    dims = lengths[0]["n"]
    rows = settle(rows.where(F.size("v") == dims).distinct())
    # of a vector that many rows share the k + 1 smallest ids are enough: first within salts, then over them
    small = lambda df, *by: df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(f"_r <= {k + 1}").drop("_r")
    held = settle(small(small(rows.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(64))), "v", "_s").drop("_s"), "v"))
    n = held.count()
    sample = np.array([r.v for r in held.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").collect()])
    depth = int(min(MOST_DEPTH, max(0, np.ceil(np.log2(max(1, n / leaf))))))
    forest = Forest(sample, trees, depth)
    shared = spark.sparkContext.broadcast(forest)  # trees x 2 ** depth directions
    leaves_ = trees * 2**depth
    blocks = min(leaves_, max(1, round(n * trees / BLOCK_ROWS)))
    parts = max(1, -(-n * trees // (leaves_ * BLOCK_ROWS)))  # of a leaf: 1, until there are more rows than leaves can hold
    most = max(2 * trees, int(np.ceil(probes * trees * 2**depth)))

    names = ["block", "part", "kind", "leaves", "id", "v"]

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)

    def put(batches):
        for batch in batches:
            x, ids = matrix(batch.column(1)), batch.column(0).to_numpy()
            home = (shared.value.leaves(x) + np.arange(trees) * 2**depth).ravel()
            row = np.repeat(np.arange(len(x)), trees)
            leaf_ = pa.ListArray.from_arrays(np.arange(len(home) + 1, dtype=np.int32), home)
            part = mix(ids[row].astype(np.uint64)) % np.uint64(parts)
            yield pa.record_batch([pa.array(home % blocks, pa.int32()), pa.array(part.astype(np.int32)), pa.array(np.zeros(len(home), np.int32)), leaf_, batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], names=names)

    def ask(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows_, block, of, leaf_ = [], [], [], []
                for i, q in enumerate(matrix(part.column(1))):
                    by: dict[int, list] = {}
                    for t, x in shared.value.probe(q, most):
                        by.setdefault((t * 2**depth + x) % blocks, []).append(t * 2**depth + x)
                    for b, leaves in by.items():
                        rows_ += [i] * parts
                        block += [b] * parts
                        of += range(parts)
                        leaf_ += [leaves] * parts
                yield pa.record_batch([pa.array(block, pa.int32()), pa.array(of, pa.int32()), pa.array([1] * len(block), pa.int32()), pa.array(leaf_, pa.list_(pa.int64())), part.column(0).take(pa.array(rows_, pa.int64())), part.column(1).take(pa.array(rows_, pa.int64()))], names=names)

    def find(batches):
        """Sorted by block, part and kind: a block's rows come first, then its queries."""
        at, held, points = None, [], None
        for batch in batches:
            block, of, kind = (batch.column(i).to_numpy() for i in range(3))
            cut = np.flatnonzero(np.diff(block) | np.diff(of) | np.diff(kind)) + 1
            out = []
            for a, z in zip([0, *cut], [*cut, len(block)], strict=True):
                own = batch.slice(a, z - a)
                if a == z:
                    continue
                if at != (block[a], of[a]):
                    at, held, points = (block[a], of[a]), [], None
                if not kind[a]:
                    held.append((own.column(3).flatten().to_numpy(), own.column(4).to_numpy(), matrix(own.column(5))))
                    continue
                if points is None and held:
                    home, ids, x = map(np.concatenate, zip(*held, strict=True))
                    order, held = np.argsort(home, kind="stable"), []
                    points = home[order], ids[order], x[order]
                if points is None:
                    continue
                home, ids, x = points
                for leaves, qid, q in zip(own.column(3), own.column(4).to_numpy(), matrix(own.column(5)), strict=True):
                    leaves = np.sort(leaves.values.to_numpy())
                    low, high = np.searchsorted(home, leaves), np.searchsorted(home, leaves, side="right")
                    near = np.concatenate([np.arange(i, j) for i, j in zip(low, high, strict=True)])
                    if len(near):
                        some, first = np.unique(ids[near], return_index=True)
                        _, found, d = nearest(x[near[first]], some, q[None], np.array([qid]), k)
                        out.append((np.full(len(found), qid), found, d))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    shape = "block int, part int, kind int, leaves array<long>, id long, v array<double>"
    points = held.mapInArrow(put, shape)
    queries = rows.where(F.col("id") % every == 0).mapInArrow(ask, shape)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks * parts // 8)
    together = points.union(queries).repartition(tasks, "block", "part").sortWithinPartitions("block", "part", "kind")
    found = together.mapInArrow(find, "query_id long, vec_id long, score double").where("score < double('infinity')")
    ranked = found.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
