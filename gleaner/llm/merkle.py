"""A Merkle manifest of a dataset: hash trees over its rows, built and proved by supersteps over RDDs.

A leaf is the digest of a row. Leaves are numbered by group (language) in the order of their ids by a range sort.
Upward, each node sends its digest to its parent, eight nodes to one; a parent is complete when the children that its
level's size promises have arrived, hashes them and sends on in the next superstep. A group's last node is its
subroot; subroots are the leaves of one more tree, which ends in the root. Downward, each parent sends its children
the path from it to the root, with the siblings at each level; at the leaves the path is hashed as the leaf's proof,
and folded with the leaf as it is found now, which must give the root again.

A superstep's nodes are written to the shared folder, so that none depends on an executor that may go. Messages
number one a node, and a level has an eighth of the nodes below it; paths are sent to parents of leaves only, and
grow with the logarithm of the rows.

Defined cases: null fields are `-` in the leaf; a null id comes after all others and is never tampered with; repeated
ids go by their leaves' digests, and equal rows behind one another; a null group is the first, apart from the empty
one; an empty table has no rows (and no root). Extra columns take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, ship

ARITY = 8
#: Nodes that one partition of a superstep should have.
NODES = 20_000

_NODE = "tree string, at long, size long, digest string"
_FAMILY = f"{_NODE}, children array<string>"
_MAIL = "tree string, at long, top boolean, subroot string, path array<struct<place:int,siblings:binary>>"
#: The tree over the groups' subroots; groups have names that begin otherwise.
TOP = "^"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: Iterable[str]) -> str:
    h = sha256()
    for p in parts:
        h.update(p.encode())
    return h.hexdigest()


def field(value: Column) -> Column:
    """`-`, or the number of its bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def tree_name(group: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("-"))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with `at`, their number within the group (never null) from 0, and `size`, the group's rows.

    Rows are sorted in ranges of (group, order), so that a group may lie in many partitions, and numbered within each;
    a salt parts rows that are equal in all these columns. Numbers go on from partition to partition by counts,
    one for each partition and group.
    """
    rows = settle(rows).withColumn("_salt", F.monotonically_increasing_id())
    parts = settle(rows.repartitionByRange(group, *order, "_salt").sortWithinPartitions(group, *order, "_salt").withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    counts = parts.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before, whole = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(group)
    counts = settle(counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size")))
    # a group of many partitions is met by (group, partition): no key has more rows than a partition
    return parts.join(counts, (parts[group] == F.col("_g")) & (F.col("_part") == F.col("_p"))).withColumn("at", F.col("_row") + F.col("_shift")).drop("_salt", "_part", "_row", "_g", "_p", "_shift")


def _sent(like: DataFrame, rdd: RDD, schema: str) -> DataFrame:
    """What a superstep sends, written and read again: the next one starts there."""
    return settle(like.sparkSession.createDataFrame(rdd, schema, verifySchema=False))


def _tasks(nodes: int) -> int:
    return max(1, -(-nodes // NODES))


def _to_parent(node) -> tuple:
    tree, at, size, own = node
    return (tree, at // ARITY), (size, ((at, own),))


def _gathered(a: tuple, b: tuple) -> tuple:
    return a[0], a[1] + b[1]


def _parent(mail) -> tuple:
    """A parent, complete with all children that its level's size promises, hashes them in order."""
    (tree, at), (below, found) = mail
    children = [d for _, d in sorted(found)]
    if len(children) != min(ARITY, below - ARITY * at):
        raise RuntimeError(f"{len(children)} children have arrived at node {at} of {tree}")
    return tree, at, -(-below // ARITY), digest(children), children


def rise(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Supersteps upward until each tree has one node left, which sends no more.

    leaves: settled (tree, at, size, digest). Gives the settled parents of each level, with their children, and
    (tree, digest) of the last nodes.
    """
    levels, nodes = [], leaves
    last = nodes.where("size = 1").select("tree", "digest")
    while n := (going := nodes.where("size > 1").select("tree", "at", "size", "digest")).count():
        parents = going.rdd.map(_to_parent).reduceByKey(_gathered, _tasks(n)).map(_parent)
        levels.append(nodes := _sent(leaves, parents, _FAMILY))
        last = last.union(nodes.where("size = 1").select("tree", "digest"))
    return levels, last


def _by_parent(mail) -> tuple:
    tree, at, *rest = mail
    return (tree, at), rest


def _path_for(size: int, mails) -> tuple:
    """(subroot, path) that is meant for a node: a tree's last node hears from the tree of subroots, others from their parents."""
    (subroot, path), = ((s, p) for top, s, p in mails if top == (size == 1))
    return subroot, [(place, bytes(siblings)) for place, siblings in path]


def _siblings(children: list[str], i: int) -> tuple[int, bytes]:
    return i, bytes.fromhex("".join(children[:i] + children[i + 1 :]))


def _to_children(pair):
    """A parent's messages: each child's siblings, and behind them the path that the parent has got itself."""
    (tree, at), (parents, mails) = pair
    mails = list(mails)
    for size, _, children in parents:
        subroot, path = _path_for(size, mails)
        for i in range(len(children)):
            yield tree, ARITY * at + i, False, subroot, [_siblings(children, i), *path]


def _to_leaves(pair):
    """(leaf, subroot, path) for all leaves of a parent; a tree's only leaf hears from the tree of subroots."""
    _, (leaves, mails) = pair
    mails, leaves = list(mails), sorted(leaves)
    for i, (_, size, own, *more) in enumerate(leaves):
        subroot, path = _path_for(-(-size // ARITY), mails)
        yield own, more, subroot, path if size == 1 else [_siblings([x[2] for x in leaves], i), *path]


def descend(levels: list[DataFrame], leaves: DataFrame, tops: DataFrame) -> RDD:
    """Supersteps downward: (digest, further columns, subroot, path) of each leaf.

    leaves: settled (tree, at, size, digest, further columns); tops: settled messages for each tree's last node, which
    are sent to its first node at every level and heard by it where it is the last.
    """
    mails = tops
    for parents in reversed(levels[1:]):
        own = parents.rdd.map(lambda p: ((p[0], p[1]), (p[2], p[3], p[4])))
        sent = own.cogroup(mails.rdd.map(_by_parent), _tasks(ARITY * parents.count())).flatMap(_to_children)
        mails = _sent(tops, sent, _MAIL).union(tops)
    own = leaves.rdd.map(lambda x: ((x[0], x[1] // ARITY), tuple(x[1:])))
    return own.cogroup(mails.rdd.map(_by_parent), _tasks(leaves.count())).flatMap(_to_leaves)


def fold(value: str, path: list[tuple[int, bytes]]) -> str:
    """The root that a leaf's digest and its path give."""
    for place, siblings in path:
        x = siblings.hex()
        value = digest([x[: 64 * place], value, x[64 * place :]])
    return value


def manifest(rows: DataFrame, group: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows with the columns id, group, leaf and
    `now`: the digest of the row as it is found at verification, which is folded with the leaf's path."""
    spark = rows.sparkSession
    ship(spark)
    rows = rows.select(tree_name(group).alias("tree"), F.col(id_col).cast("long").alias("doc_id"), "leaf", "now").withColumn("_last", F.col("doc_id").isNull())
    leaves = settle(numbered(rows, "tree", "_last", "doc_id", "leaf").select("tree", "at", "size", F.col("leaf").alias("digest"), "doc_id", "now"))
    levels, subroots = rise(leaves)
    # the subroots are leaves of the tree above: null is before all names there too
    top = settle(numbered(subroots.select(F.lit(TOP).alias("_top"), "tree", "digest"), "_top", "tree").select(F.col("_top").alias("tree"), "at", "size", "digest", F.col("tree").alias("of")))
    upper, found = rise(top)
    root = next((r["digest"] for r in found.collect()), None)  # one node
    start = settle(spark.createDataFrame([(TOP, 0, True, None, [])], _MAIL))
    tops = _sent(top, descend(upper, top, start).map(lambda x: (x[1][0], 0, True, x[0], x[3])), _MAIL)

    def proved(leaf) -> tuple:
        own, (doc, now), subroot, path = leaf
        folded = fold(now, path)
        return doc, own, subroot, root, digest(s.hex() for _, s in path), folded, folded == root

    return _sent(rows, descend(levels, leaves, tops).map(proved), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, verified against a copy in which every third text (by a checksum of its id) has no capitals."""
    kept = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    now = F.when(changed & F.col("text").isNotNull(), leaf(*kept, F.translate("text", UPPER, LOWER)))
    return manifest(docs.select("doc_id", "lang", (own := leaf(*kept, F.col("text"))).alias("leaf"), F.coalesce(now, own).alias("now")))
