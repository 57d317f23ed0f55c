"""Near-duplicates by SetSketch registers.

Each document's set of word shingles is summarised by registers: for every register an independent hash
gives each shingle an exponential variate, and the register keeps the largest floor(1 - log_b(x)), truncated to
[0, q + 1]; so registers are exponentially spaced truncated minima. They merge by maximum, and two sets
agree in a register about as often as they are similar, so bands of register values find candidates. A
candidate's similarity is first estimated jointly from the order of the two sketches' registers by maximum
likelihood, and then verified on the full shingle sets.

Groups of any size: documents with equal shingle words are one class from the start (an aggregate that
combines before the shuffle). In a bucket every class is compared with three leaders only (least, largest,
least by hash); then what the verified links join is one component. Buckets that still hold several
components are swept: each pair of classes of different components is compared. So no pair within a group
is emitted once the group is joined, and no pair that shares a band goes unjudged.

Defined cases: null text, empty text or text without words gives an empty set, linked with nothing; fewer
words than a shingle has give one shingle of all words; null doc_id counts as the largest id; rows that share
an id (null too) but not their text are judged each by its own text; repeated rows are copies, so a row with the
smallest id of its component is kept as often as it stands; an empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hashes, asked, bitmap, components, doc_key, groups, looked_up, lower_words_of, odd_numbers, places, runs, settle, ship, trim

#: SetSketch parameters: base, rate, largest register value; bands and registers in each.
BASE, RATE, LIMIT = 1.02, 20.0, 2**14 - 2
BANDS, ROWS = 24, 5
#: A candidate goes on to verification if its estimate is no further than this below the threshold:
#: over five standard errors of 120 registers.
SLACK = 0.2
#: Classes of a bucket that a task of the sweep takes on each side.
BLOCK = 1024
#: Bytes of their sets, on average.
BLOCK_BYTES = 64 << 20


def shingle_hashes(words: list[bytes], size: int, hashes: Hashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of words."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(runs(hashes.array(words), min(size, len(words)), seed=5))


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _text_hash(text: str):
    """Tells texts apart whose rows share an id; never null."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


_SALTS = odd_numbers(2 * BANDS * ROWS, 23)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes: with x = -log(1 - u) / RATE of each register's least u."""
    m = BANDS * ROWS
    least = np.full(m, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512]
        np.minimum(least, ((part ^ _SALTS[:m, None]) * _SALTS[m:, None]).min(axis=1), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    return np.clip(np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(BASE)), 0, LIMIT + 1).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity of pairs of sketches (rows of a and b) with known set sizes, by maximum likelihood.

    With u, v the sizes' shares, P(Ka > Kb) = p(u - v J) and P(Ka < Kb) = p(v - u J),
    p(x) = -log_b(1 - x (b - 1) / b); the likelihood of the counts is searched by golden section.
    """
    more, less = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    same = a.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def score(j):
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    g = (np.sqrt(5) - 1) / 2
    for _ in range(24):
        x, y = high - g * (high - low), low + g * (high - low)
        left = score(x) > score(y)
        high, low = np.where(left, y, high), np.where(left, low, x)
    return (low + high) / 2


def sketch(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """(doc, text_hash, n, digest, sketch) of each row: set size, digest of the set, registers."""
    ship(docs.sparkSession)

    def run(batches):
        hashes = Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, out = batch.slice(at, 1000), []
                for x in part.column(2).to_pylist():
                    s = shingle_hashes(lower_words_of(x), size, hashes)
                    out.append((len(s), _digest(s), registers(s).tobytes()) if len(s) else (0, None, None))
                yield pa.record_batch([part.column(0), part.column(1), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], names=["doc", "text_hash", "n", "digest", "sketch"])
        del hashes
        trim()

    return docs.select(doc_key(key).alias("doc"), _text_hash(text).alias("text_hash"), F.col(text).alias("text")).mapInArrow(run, "doc long, text_hash binary, n long, digest binary, sketch binary")


def _bands(classes: DataFrame) -> DataFrame:
    """(band, rep): one row for each band of each class; the key is a hash of band number and register values."""
    w = 2 * ROWS
    # the low five bits are the band's number
    keys = F.array(*(F.xxhash64(F.substring("sketch", i * w + 1, w)).bitwiseAND(F.lit(-32)).bitwiseOR(F.lit(i)) for i in range(BANDS)))
    return classes.select("rep", F.explode(keys).alias("band"))


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of class representatives whose estimate isn't far below the threshold."""
    one = lambda c: classes.select(F.col("rep").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n").alias(f"n{c}"))

    def judge(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, BANDS * ROWS) for i in (2, 3))
                na, nb = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (4, 5))
                keep = pa.array(estimate(a, b, na, nb) >= threshold - SLACK)
                yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    # no set can be that similar to one much smaller
    full = pairs.join(one("a"), "a").join(one("b"), "b").where(f"least(na, nb) >= {threshold - 1e-9} * greatest(na, nb)")
    return full.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(judge, "a long, b long")


def _sets(docs: DataFrame, needed: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(rep, shingles) of the classes in needed (rep, doc, digest; settled): distinct shingle hashes.

    A row is of a class if its id and the digest of its set are; its id alone is not enough, as rows may share it.

    A bitmap of fixed size rules out most other documents as they are read; what travels are sets, not texts.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(needed))

    def sets(batches):
        hashes = Hashes()
        for batch in batches:
            batch = batch.filter(pa.array(asked(bits.value, batch.columns[2:5]))) if batch.num_rows else batch
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [shingle_hashes(lower_words_of(x), size, hashes) for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array([_digest(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["doc", "digest", "shingles"])
        del hashes
        trim()

    rows = docs.select(doc_key(key).alias("doc"), F.col(text).alias("text")).select("doc", "text", *(p.alias(f"p{i}") for i, p in enumerate(places())))
    return rows.mapInArrow(sets, "doc long, digest binary, shingles binary").join(needed, ["doc", "digest"]).dropDuplicates(["doc", "digest"]).select("rep", "shingles")


def _needed(reps: DataFrame, classes: DataFrame) -> DataFrame:
    """(rep, doc, digest) of these classes, settled."""
    return settle(reps.distinct().join(classes.select("rep", "doc", "digest"), "rep"), classes.count())


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Of pairs (settled), those whose full sets have 100 * intersection >= percent * union."""
    needed = _needed(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")), classes)

    def judge(batches):
        for batch in batches:
            a, b, keep = batch.column(2).to_pylist(), batch.column(3).to_pylist(), []
            for x, y in zip(a, b, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    found = settle(_sets(docs, needed, key, text, size))
    one = lambda c: found.select(F.col("rep").alias(c), F.col("shingles").alias(f"s{c}"))
    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "sa", "sb").mapInArrow(judge, "a long, b long")


def _roots(parent: dict[int, int], i: int) -> int:
    while parent.setdefault(i, i) != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _sweep(rows: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """(a, b): of links between different components, within buckets, enough to join what they join.

    rows: (band, rep, component, blocks). A bucket's classes are parted in blocks by hash, and each pair of
    blocks is compared in a task of its own, in memory: first by sketches, to find who may have a link at
    all, then by the full sets of these. What a task returns grows with its classes, not with their pairs.
    """
    threshold, least = percent / 100, (BANDS * ROWS) * (percent / 100 - SLACK) * 0.9
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    spread = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select(F.col("band"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "component", (F.col("block") > F.col("other")).cast("int").alias("side"))

    def ask(batches):
        for (band, i, j), held in groups(batches, 3):
            ids, comps, side, n = (np.array([r[c] for r in held]) for c in range(4))
            k = np.frombuffer(b"".join(r[4] for r in held), "<u2").reshape(-1, BANDS * ROWS)
            one, two = (np.arange(len(ids)),) * 2 if i == j else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            if len(one) * len(two) <= 4096:
                same = (k[one][:, None] == k[two]).sum(2)
            else:
                same = np.zeros((len(one), len(two)), np.int16)
                for c in range(BANDS * ROWS):
                    same += k[one, c][:, None] == k[two, c]
            near = (same >= least) & (comps[one][:, None] != comps[two]) & (np.minimum(n[one][:, None], n[two]) >= (threshold - 1e-9) * np.maximum(n[one][:, None], n[two]))
            p, q = np.nonzero(np.triu(near, 1) if i == j else near)
            p, q = one[p], two[q]
            wanted: set[int] = set()
            for at in range(0, len(p), 20_000):
                u, v = p[at : at + 20_000], q[at : at + 20_000]
                # a pair is judged in the first band that it shares
                shared = (k[u].reshape(-1, BANDS, ROWS) == k[v].reshape(-1, BANDS, ROWS)).all(2).argmax(1) == band % 32
                u, v = u[shared], v[shared]
                if not len(u):
                    continue
                fit = estimate(k[u], k[v], n[u].astype(float), n[v].astype(float)) >= threshold - SLACK
                wanted.update(u[fit].tolist(), v[fit].tolist())
            w = sorted(wanted)
            yield pa.record_batch([pa.array([band] * len(w), pa.int64()), pa.array([i] * len(w), pa.int32()), pa.array([j] * len(w), pa.int32()), pa.array(side[w], pa.int32()), pa.array(ids[w], pa.int64()), pa.array(comps[w], pa.int64())], names=["band", "i", "j", "side", "rep", "component"])

    def judge(batches):
        for (_, i, j), held in groups(batches, 3):
            sets = [np.frombuffer(r[3], np.uint64) for r in held]
            n = np.array([len(x) for x in sets])
            every = np.concatenate(sets)
            known, where, often = np.unique(every, return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(len(sets)), n)[often[where] > 1]  # what one set alone holds is in no intersection
            column = np.cumsum(often > 1)[where[often[where] > 1]] - 1
            both = np.zeros((len(sets), len(sets)), np.float32)
            for at in range(0, int((often > 1).sum()), 2048):
                m = np.zeros((len(sets), 2048), np.float32)
                own = (column >= at) & (column < at + 2048)
                m[row[own], column[own] - at] = 1
                both += m @ m.T
            union = n[:, None] + n - both
            side, comps = np.array([r[0] for r in held]), np.array([r[2] for r in held])
            link = (100 * both.astype(np.float64) >= percent * union) & (comps[:, None] != comps)
            if i != j:
                link &= side[:, None] != side
            parent: dict[int, int] = {}
            a, b = [], []
            for x, y in zip(*np.nonzero(np.triu(link, 1)), strict=True):
                u, v = _roots(parent, int(comps[x])), _roots(parent, int(comps[y]))
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    a.append(held[x][1])
                    b.append(held[y][1])
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    group = ["band", "i", "j"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketches = spread.join(classes.select("rep", "n", "sketch"), "rep").select(*group, "rep", "component", "side", "n", "sketch")
    wanted = settle(sketches.repartition(parts, *group).sortWithinPartitions(*group).mapInArrow(ask, "band long, i int, j int, side int, rep long, component long"))
    sets = _sets(docs, _needed(wanted.select("rep"), classes), key, text, size)
    return wanted.join(sets, "rep").select(*group, "side", "rep", "component", "shingles").repartition(parts, *group).sortWithinPartitions(*group).mapInArrow(judge, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(doc, text_hash, n_shingles, component) for each row; linked are sets with 100 * intersection >= percent * union."""
    threshold = percent / 100
    rows = settle(sketch(docs, key, text, size))
    # doc, the smallest id of a class, may be that of other classes too: rep is a number of its own
    classes = rows.where("n > 0").groupBy("digest").agg(F.min("doc").alias("doc"), F.first("sketch").alias("sketch"), F.first("n").alias("n"), F.count("*").alias("copies"))
    classes = settle(classes.select(F.monotonically_increasing_id().alias("rep"), "doc", "sketch", "n", "digest", "copies"), rows.count(), 50_000)
    m = classes.count()
    leaders = [F.min("rep"), F.max("rep"), F.min_by("rep", F.xxhash64("rep"))]
    bands = _bands(classes)
    buckets = bands.groupBy("band").agg(F.count("*").alias("n"), F.array_distinct(F.array(*leaders)).alias("leaders")).where("n > 1").select("band", "leaders")
    members = settle(bands.join(buckets, "band"), BANDS * m, 500_000)
    pairs = members.select("rep", F.explode("leaders").alias("leader")).where("rep <> leader").select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
    likely = settle(_likely(pairs, classes, threshold), len(leaders) * members.count(), 500_000)
    links = settle(_verified(likely, classes, docs, key, text, size, percent), likely.count(), 2_000)
    labels = components(links)

    # the sweep: buckets that hold several components still
    now = settle(members.select("band", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), members.count(), 500_000)
    mixed = now.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size")).where("x <> y").select("band", "size")
    mixed = settle(now.join(mixed, "band").join(classes.select("rep", "n"), "rep"), now.count(), 500_000)
    blocks = mixed.groupBy("band").agg(F.greatest(F.ceil(F.max("size") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    more = settle(_sweep(mixed.select("band", "rep", "component").join(blocks, "band"), classes, docs, key, text, size, percent))
    if more.limit(1).count():
        labels = components(links.union(more))

    # a component is named by the smallest id of its classes
    labelled = classes.select("digest", "rep", "doc", "copies").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    lowest = settle(labelled.where("component is not null").groupBy("component").agg(F.min("doc").alias("least"), F.count("*").alias("size")), m)
    named = looked_up(labelled, "component", lowest, "least", "size")
    of_class = settle(named.select("digest", F.coalesce("least", "doc").alias("component"), "copies"), m)
    return looked_up(rows, "digest", of_class, "component", "copies").select("doc", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component"))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 85) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row."""
    null = F.lit(2**63 - 1)
    back = lambda c: F.when(F.col(c) != null, F.col(c))
    found = near_duplicates(docs, key, text, size, percent)
    return found.select(back("doc").alias(key), "n_shingles", back("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that are near-duplicates of one with a smaller id; columns stay."""
    gone = near_duplicates(docs, key, text, size, percent).where("doc <> component").select("doc", "text_hash").distinct()
    names = {c: f"_{i}_" for i, c in enumerate(docs.columns)}  # docs may have columns of any name
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), doc_key(key).alias("doc"), _text_hash(text).alias("text_hash"))
    return rows.join(gone, ["doc", "text_hash"], "left_anti").select(*(F.col(n).alias(c) for c, n in names.items()))
