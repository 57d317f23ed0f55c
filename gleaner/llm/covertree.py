"""Exact near-duplicate pairs of vectors by dual traversal of cover trees.

Vectors of equal label link if their cosine is at least the threshold; for unit vectors that is a bound on
their distance. A cover tree holds nested levels whose radii halve; two trees are walked together, and a
pair of nodes is dropped when the distance of its centres less both covering radii is beyond the bound.
What is left at the leaves is compared by cosine in double precision, so the links are exact.

Scale: equal vectors of a label are one class (an aggregate that combines before the shuffle). The classes of a
label lie in cells of CELL rows and CELL_BYTES at most on average: nearest of a bounded set of pivots first, and by
a hash where a pivot has more. Cells have a centre and a covering radius, the top level of the traversal: only pairs of
cells that these don't separate meet, each pair by itself, streamed. What a pair returns is a count for each class and a
spanning forest of its links, never all pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
label, link with nothing; vectors of different lengths don't link; null ids count as the largest id; rows
that share an id (null too) are judged each by its own vector, and a copy counts among n_links; a component's name is
the smallest id of its rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, doc_key, groups, looked_up, settle, ship, trim
from .forest import fine, usable

THRESHOLD = 0.93
CELL, CELL_BYTES = 4096, 16 << 20
PIVOTS = 256
#: Nodes of so few vectors aren't parted further, nor are those whose children would hold fewer than SPREAD on average.
LEAF, SPREAD = 64, 4


class Node:
    __slots__ = ("centre", "children", "radius", "rows")

    def __init__(self, centre: np.ndarray, radius: float, rows: np.ndarray, children: list[Node]):
        self.centre, self.radius, self.rows, self.children = centre, radius, rows, children


def build(x: np.ndarray, rows: np.ndarray | None = None, scale: float = 2.0) -> Node:
    """The cover tree of unit vectors x: a node's children are centred at its own members, at most scale / 2 from theirs."""
    rows = np.arange(len(x)) if rows is None else rows
    centre = x[rows[0]]
    d = np.sqrt(np.maximum(2 - 2 * x[rows] @ centre, 0))
    radius = float(d.max())
    if len(rows) <= LEAF or radius < 1e-6:
        return Node(centre, radius, rows, [])
    scale /= 2
    while scale >= radius:
        scale /= 2
    groups_, rest = [], rows
    while len(rest):  # nested: the first child has the node's own centre
        if (len(groups_) + 1) * SPREAD > len(rows):
            return Node(centre, radius, rows, [])
        own = np.maximum(2 - 2 * x[rest] @ x[rest[0]], 0) <= scale * scale
        own[0] = True
        groups_.append(rest[own])
        rest = rest[~own]
    return Node(centre, radius, rows, [build(x, g, scale) for g in groups_])


def dual(a: Node, b: Node, xa: np.ndarray, xb: np.ndarray, threshold: float, found, whole) -> None:
    """Call found(rows of a, rows of b) for blocks of links, or whole(rows of a, rows of b, same) where all of two nodes
    link (same: one node with itself); a is b: each pair once."""
    reach = np.sqrt(max(0.0, 2 - 2 * threshold))
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        if not p.children and not q.children:
            for at in range(0, len(p.rows), 512):  # leaves of one place may be large
                i, j = np.nonzero(xa[p.rows[at : at + 512]] @ xb[q.rows].T >= threshold)
                i = i + at
                if p is q:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    found(p.rows[i], q.rows[j])
            continue
        left = p.children or [p]
        right = q.children or [q]
        cl, cr = np.array([n.centre for n in left]), np.array([n.centre for n in right])
        rl, rr = np.array([n.radius for n in left]), np.array([n.radius for n in right])
        for at in range(0, len(left), 1024):
            d = np.sqrt(np.maximum(2 - 2 * cl[at : at + 1024] @ cr.T, 0))
            both = rl[at : at + 1024, None] + rr
            i, j = np.nonzero(d <= reach + 1e-7 + both)
            inside = (d[i, j] + both[i, j] <= reach - 1e-7).tolist()
            for s, t, all_ in zip((i + at).tolist(), j.tolist(), inside, strict=True):
                if p is not q or s <= t:
                    if all_:
                        whole(left[s].rows, right[t].rows, left[s] is right[t])
                    else:
                        todo.append((left[s], right[t]))


def _roots(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    r = parent[i]
    while not np.array_equal(up := parent[r], r):
        r = up
    return r


def links_of(xa: np.ndarray, na: np.ndarray, xb: np.ndarray | None, nb: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Link counts of the classes of a and b (weighed by their sizes), and a spanning forest of the links.

    Indices of b in the forest follow those of a. Without b, the links within a.
    """
    m = len(xa)
    size = np.concatenate([na, nb]) if xb is not None else na
    count, parent, forest = np.zeros(len(size), np.int64), np.arange(len(size)), []
    move = m if xb is not None else 0

    def join(i: int, js: np.ndarray) -> None:
        """Row i links to all of js: their components are one."""
        tops, at = np.unique(_roots(parent, js), return_index=True)
        own = int(_roots(parent, np.array([i]))[0])
        forest.extend((i, int(js[k])) for t, k in zip(tops.tolist(), at.tolist(), strict=True) if t != own)
        parent[tops] = parent[own] = min(own, int(tops[0]))

    def found(i, j):
        """Rows of i come in order."""
        j = j + move
        np.add.at(count, i, size[j])
        np.add.at(count, j, size[i])
        open_ = _roots(parent, i) != _roots(parent, j)
        i, j = i[open_], j[open_]
        cut = np.flatnonzero(np.diff(i, prepend=-1)).tolist() if len(i) else []
        for a, z in zip(cut, [*cut[1:], len(i)], strict=False):
            join(int(i[a]), j[a:z])

    def whole(i, j, same):
        j = j + move
        count[i] += size[j].sum() - (size[i] if same else 0)
        if not same:
            count[j] += size[i].sum()
            join(int(j[0]), i)
        if not same or len(i) > 1:
            join(int(i[0]), j[1:] if same else j)

    ta = build(xa)
    dual(ta, ta if xb is None else build(xb), xa, xa if xb is None else xb, threshold, found, whole)
    return count[:m], count[m:], forest


_OUT = "a long, b long, n long"


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)


def near_pairs(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """classes (rep, label, doc, v, n; doc: the smallest id) and, for these, rows (a, b, n): b null: a has n links to other classes; else a link."""
    spark = vectors.sparkSession
    ship(spark)
    named = vectors.select(doc_key(key).alias("id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    rows = usable(named, "id", "v", ("label",)).where(F.col("label").isNotNull())
    # an id may be that of several classes: rep is a number of its own
    classes = settle(rows.groupBy("label", "v").agg(F.min("id").alias("doc"), F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("rep"), "label", "doc", "v", "n"))
    pivots = classes.orderBy(F.xxhash64("rep"), "rep").limit(PIVOTS).select("v").collect()
    if not pivots:
        return classes, spark.createDataFrame([], _OUT)
    unit: dict[int, list] = {}
    for p in pivots:
        unit.setdefault(len(p.v), []).append(np.array(p.v) / np.linalg.norm(p.v))
    shared = spark.sparkContext.broadcast({n: np.array(x) for n, x in unit.items()})  # PIVOTS vectors

    def place(batches):
        """Unit vectors and the nearest pivot of each."""
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                v = part.column(3)
                dims = np.diff(v.offsets.to_numpy())
                flat = v.flatten().to_numpy(zero_copy_only=False)
                units, nearest, start = [b""] * len(dims), np.full(len(dims), -1, np.int32), np.cumsum(dims) - dims
                for d in np.unique(dims):
                    own = np.flatnonzero(dims == d)
                    x = flat[start[own][:, None] + np.arange(d)]
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    if d in shared.value:
                        nearest[own] = np.argmax(x @ shared.value[d].T, axis=1)
                    for i, u in zip(own.tolist(), x, strict=True):
                        units[i] = u.astype("<f8").tobytes()
                yield pa.record_batch([part.column(0), part.column(1), part.column(2), pa.array(dims, pa.int32()), pa.array(units, pa.binary()), pa.array(nearest)], names=["rep", "label", "n", "dims", "u", "pivot"])
        trim()

    kind = classes.schema["label"].dataType.simpleString()
    units = settle(classes.select("rep", "label", "n", "v").mapInArrow(place, f"rep long, label {kind}, n long, dims int, u binary, pivot int"))
    # small pivots' classes are gathered in common cells, large ones are parted by hash
    group, most = ["label", "dims", "pivot"], F.greatest(F.lit(min(64, CELL)), F.least(F.lit(CELL), F.expr(f"{CELL_BYTES} div (8 * dims)")))
    sizes = units.groupBy(*group).agg(F.count("*").alias("m")).withColumn("most", most)
    w = Window.partitionBy("label", "dims").orderBy(F.when(F.col("m") >= F.col("most"), 1).otherwise(0), "pivot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("m").over(w), F.lit(0)))
    sizes = sizes.select(*group, F.when(F.col("m") >= F.col("most"), F.concat_ws(".", F.lit("p"), "pivot")).otherwise(F.concat_ws(".", F.lit("s"), F.expr("cast(_before div most as string)"))).alias("name"), F.greatest(F.lit(1), F.ceil(F.col("m") / F.col("most"))).cast("long").alias("parts"))
    celled = units.join(sizes, group)
    celled = settle(celled.select("rep", "n", "u", "dims", F.col("label").cast("string").alias("label"), F.concat_ws("/", F.col("label").cast("string"), F.col("dims").cast("string"), "name", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("string")).alias("cell")))

    def ball(batches):
        for (cell,), held in groups(batches, 1):
            x = _matrix([h[2] for h in held])
            c = x.mean(0)
            yield pa.record_batch([pa.array([cell]), pa.array([held[0][0]]), pa.array([held[0][1]], pa.int32()), pa.array([c.tolist()]), pa.array([float(np.sqrt(((x - c) ** 2).sum(1)).max())])], names=["cell", "label", "dims", "c", "r"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = celled.select("cell").distinct().count()
    balls = settle(celled.select("cell", "label", "dims", "u").repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(ball, "cell string, label string, dims int, c array<double>, r double"), cells, 200)
    bound = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6)
    a, b = (balls.select("label", "dims", *(F.col(c).alias(f"{c}{s}") for c in ("cell", "c", "r"))) for s in ("1", "2"))
    apart = F.sqrt(F.aggregate(F.zip_with("c1", "c2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    pairs = a.join(b, ["label", "dims"]).where("cell1 <= cell2").where(apart - F.col("r1") - F.col("r2") <= bound).select("cell1", "cell2")

    pairs = settle(pairs.withColumn("pair", F.concat_ws("|", "cell1", "cell2")))
    left = pairs.join(celled.withColumnRenamed("cell", "cell1"), "cell1").select("pair", F.lit(1).alias("side"), "rep", "n", "u")
    right = pairs.where("cell1 < cell2").join(celled.withColumnRenamed("cell", "cell2"), "cell2").select("pair", F.lit(2).alias("side"), "rep", "n", "u")

    def judge(batches):
        for _, held in groups(batches, 1):
            side, rep, n = (np.array([h[i] for h in held], np.int64) for i in range(3))
            one, two, x = side == 1, side == 2, _matrix([h[3] for h in held])
            del held
            m, k, forest = links_of(x[one], n[one], x[two] if two.any() else None, n[two] if two.any() else None, threshold)
            reps, count = np.concatenate([rep[one], rep[two]]), np.concatenate([m, k])
            some, f = np.flatnonzero(count), np.array(forest, dtype=np.int64).reshape(-1, 2)
            none, zero = pa.nulls(len(some), pa.int64()), pa.array(np.zeros(len(f), np.int64))
            yield pa.record_batch([pa.array(reps[some]), none, pa.array(count[some])], names=["a", "b", "n"])
            yield pa.record_batch([pa.array(reps[f[:, 0]]), pa.array(reps[f[:, 1]]), zero], names=["a", "b", "n"])
        trim()

    tasks = max(parts, pairs.count() // 8)
    return classes, left.union(right).repartition(tasks, "pair").sortWithinPartitions("pair", "side").mapInArrow(judge, _OUT)


def components_of(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) for each row."""
    classes, found = near_pairs(vectors, threshold, key, vector, label)
    found = settle(found)
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    labels = components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "rep")
    labelled = classes.join(labels, "rep", "left")
    # a component is named by the smallest id of its classes
    lowest = settle(labelled.where("component is not null").groupBy("component").agg(F.min("doc").alias("least"), F.count("*").alias("size")))
    of_class = looked_up(labelled, "component", lowest, "least", "size").join(counts, "rep", "left").select(F.struct("label", "v").alias("_key"), F.struct((F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("least", "doc").alias("component")).alias("_found"), "n")
    # vectors that many rows share are looked up in a broadcast; rows that take no part have no key, and are dealt apart
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(doc_key(key).alias("_id"), F.when(F.col(label).isNotNull() & fine(v), F.struct(F.col(label).alias("label"), v.alias("v"))).alias("_key"))
    null = F.lit(2**63 - 1)
    back = lambda c: F.when(c != null, c)
    component = F.coalesce("_found.component", "_id")
    return looked_up(rows, "_key", settle(of_class), "_found", "n").select(back(F.col("_id")).alias(key), F.coalesce("_found.links", F.lit(0)).cast("long").alias("n_links"), back(component).alias("component_id"), (F.col("_id") == component).alias("kept"))
