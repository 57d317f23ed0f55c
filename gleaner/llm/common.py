"""What the operators of this subpackage share: folders, words, digests, components."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: dict[str, str] = {}
_folders: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Make this package importable in every Python worker, once for each application.

    Also keeps batches for Python small, in rows and in bytes, and those that are read in rows: a batch is held twice by
    the executor and once by the worker, and texts may have any length. A value that the session sets itself stays.
    """
    sc = spark.sparkContext
    small = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b"), ("spark.sql.parquet.columnarReaderBatchSize", "4096", "1024"))
    for name, usual, own in small:
        if spark.conf.get(name, usual) in (usual, usual.rstrip("b")):
            spark.conf.set(name, own)
    if sc.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp()) / "gleaner.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(target))
    _shipped[sc.applicationId] = str(target)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, where all of the application's go when it ends.

    Where that is unset a local master (tests) gets a temporary one, and a cluster an error: executors share no local folder.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _folders:
        base = sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        own = _folders[sc.applicationId] = f"{base.rstrip('/')}/gleaner-{sc.applicationId}"
        path = sc._jvm.org.apache.hadoop.fs.Path(own)
        store = path.getFileSystem(sc._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
    return f"{_folders[sc.applicationId]}/{uuid.uuid4().hex}"


def settle(df: DataFrame, rows: int | None = None, each: int = 200_000) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends at files that outlive executors.

    rows: a bound of df's rows where one is known; then there are no more files (and tasks that write them) than
    `each` rows a file take, as a file costs calls to its store whatever it holds.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    (df if rows is None else df.coalesce(max(1, -(-rows // each)))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_key(name: str = "doc_id"):
    """doc_id as a key that is never null: null counts as the largest id."""
    return F.coalesce(F.col(name).cast("long"), F.lit(2**63 - 1))


# -- words --------------------------------------------------------------------------------

#: The six ASCII blanks that part words, 0x20 and 0x09 to 0x0D.
BLANKS = b" \t\n\x0b\x0c\r"


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8; bytes.split() parts at just these blanks."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def lower_words_of(text: str | None) -> list[bytes]:
    """The same with A-Z (and no other letter) lower-cased, as bytes.lower() does."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


class Hashes(dict):
    """word -> 64-bit hash, kept for frequent words; emptied when `most` words are held."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        get = self.__getitem__
        return np.fromiter(map(get, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser (multiply, xor-shift) over 64-bit integers; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(raw: bytes) -> np.ndarray:
    """Hashes of words joined by one space each: eight bytes of every word at once, then the next eight of longer ones."""
    n = len(raw)
    padded = raw + bytes(8)
    gaps = np.flatnonzero(np.frombuffer(padded, np.uint8, n) == 32)
    starts = np.concatenate([[0], gaps + 1])
    sizes = np.concatenate([gaps, [n]]) - starts
    eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    h = mix(sizes.astype(np.uint64) + np.uint64(1))
    at, left = starts, sizes
    on = np.arange(len(starts))
    while len(on):
        part = eight[at] & np.where(left < 8, (np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1), np.uint64(2**64 - 1))
        h[on] = mix(h[on] ^ part)
        more = left > 8
        on, at, left = on[more], at[more] + 8, left[more] - 8
    return h


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs(h: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Hash of every k consecutive values of h (order counts), joined from runs of 1, 2, 4, ... values."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    odd = odd_numbers(130, seed)
    power, have, out, step = mix(h + odd[0]), 1, None, 1
    while True:
        if k & have:  # this run joins on the right of what there is
            if out is None:
                out, size = power, have
            else:
                n = len(h) - size - have + 1
                out = mix(out[:n] * odd[step] + power[size : size + n] * odd[step + 1])
                size += have
        if 2 * have > k:
            return out[: len(h) - k + 1]
        n = len(power) - have
        power = mix(power[:n] * odd[step + 64] + power[have:])
        have, step = 2 * have, step + 2


def _narrowed(rows: DataFrame, value, size: int, near: int) -> tuple[int, int, int]:
    """(low, high, above): the `size`-th largest value, which is not negative, lies between low and high; `above` rows are beyond.

    Histograms of 1,024 bins, each over the bin before that holds it, until that has `near` rows at most or one value.
    """
    low, high, n = rows.agg(F.min(value), F.max(value), F.count("*")).first()
    above = 0
    while n > near and high > low:
        step = (high - low) // 1024 + 1
        bins = rows.where(value.between(low, high)).groupBy(F.floor((value - F.lit(low)) / step) if high < 2**50 else F.shiftright(value - F.lit(low), step.bit_length())).count().collect()
        width = step if high < 2**50 else 1 << step.bit_length()
        for at, n in sorted(map(tuple, bins), reverse=True):
            if above + n >= size:
                low, high = low + at * width, min(high, low + (at + 1) * width - 1)
                break
            above += n
    return low, high, above


def most_frequent(counts: DataFrame, size: int, least: int = 1) -> list:
    """Rows of settled counts (word, n) with the largest n: `size` of them, or all if there are fewer.

    Ties at the cut go by a hash of the word, then by its bytes. Exact for counts of any size; what comes to the
    driver is `size` rows and a bounded rest.
    """
    rows, near, n = counts.where(f"n >= {least}"), 1000, F.col("n")
    if rows.count() <= size + near:
        found = rows.withColumn("_h", F.shiftrightunsigned(F.xxhash64("word"), 1)).collect()
    else:
        low, high, above = _narrowed(rows, n, size, near)
        h = F.shiftrightunsigned(F.xxhash64("word"), 1)
        rows = rows.withColumn("_h", h)
        own = n.between(low, high)
        if low == high:  # perhaps many words of one count: of these the ones with the least hashes
            back = F.lit(2**63 - 1) - F.col("_h")
            own = own & (back >= _narrowed(rows.where(own), back, size - above, near)[0])
        found = rows.where((n > high) | own).collect()
    best = sorted(found, key=lambda r: (-r["n"], r["_h"], r["word"]))[:size]
    return sorted(best, key=lambda r: (-r["n"], r["word"]))


def looked_up(rows: DataFrame, key: str, table: DataFrame, value: str, size: str, share: int = 1000) -> DataFrame:
    """rows with `value` of a settled table with one row for each key; null for other keys. size: about how many rows ask for it.

    Keys that one in `share` of all rows ask for, so `share` at most, are looked up in a broadcast, and all others joined.
    What is found by then, and rows without a key, are dealt by numbers of their own: no task gets a key's rows.
    """
    total = table.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = F.col(size) * share >= total
    known = rows.join(F.broadcast(table.where(hot).select(key, F.col(value).alias("_hot"))), key, "left")
    dealt = known.withColumn("_salt", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id() + 1))
    rest = table.where(~hot).select(key, F.lit(0).cast("long").alias("_salt"), F.col(value).alias("_rest"))
    return dealt.join(rest, [key, "_salt"], "left").withColumn(value, F.coalesce("_hot", "_rest")).drop("_hot", "_rest", "_salt")


# -- which ids are asked for: a bitmap of fixed size that only prunes ------------------------

BITS = 1 << 24


def places(key: str = "doc") -> list:
    """The key's three places in the bitmap."""
    return [F.pmod(F.xxhash64(F.lit(i), F.col(key)), F.lit(BITS)) for i in range(3)]


def bitmap(ids: DataFrame, key: str = "doc") -> np.ndarray:
    """2 MB, whatever the number of ids; when it fills up it prunes less, and the join behind it is exact."""
    rows = ids.select(F.explode(F.array(*places(key))).alias("p")).groupBy(F.expr("cast(p div 64 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("b")).toPandas()
    out = np.zeros(BITS // 64, np.uint64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def asked(bits: np.ndarray, columns) -> np.ndarray:
    """Rows whose places are all set."""
    hit = np.ones(len(columns[0]), bool)
    for c in columns:
        p = c.to_numpy(zero_copy_only=False)
        hit &= (bits[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return hit


# -- connected components -----------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that can be reached from each id of edges (a, b).

    Minimum labels with pointer jumping: each round takes the least label among neighbours, then the
    label of that label, so that chains shorten by half. Every round is written to the shared folder.
    Loops (a = b) and repeated or reversed edges are harmless; no edges give no rows.
    """
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    n = both.count()  # no fewer than there are ids
    labels = settle(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), n)
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        up = labels.select(F.col("id").alias("to"), F.col("component").alias("above"))
        new = settle(step.join(up, "to", "left").select("id", F.least("to", "above").alias("component"), "was"), n)
        labels = new.select("id", "component")
        if not new.where("component <> was").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def groups(batches, keys: int):
    """(key, rows) of a partition that is sorted by its first `keys` columns; holds one group at a time."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != at:
                if rows:
                    yield at, rows
                at, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield at, rows


def trim() -> None:
    """Give freed memory back to the system: a worker outlives its task, and C's allocator would keep it."""
    import ctypes

    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


_made: dict[str, tuple] = {}


def once(kind: str, of, make):
    """make(of), once for each worker process: kept for its later tasks until another `of` is asked for."""
    if kind not in _made or _made[kind][0] != of:
        _made[kind] = of, make(of)
    return _made[kind][1]


# -- memory-mapped blobs ------------------------------------------------------------------


def share(spark: SparkSession, blob: bytes) -> str:
    """The name of a file with blob that Spark gives to each executor, also to those that come later."""
    path = Path(tempfile.mkdtemp()) / f"{uuid.uuid4().hex}.bin"
    path.write_bytes(blob)
    spark.sparkContext.addFile(str(path))
    return path.name


def shared_map(name: str):
    """That file as a memory map, whose pages all workers of an executor share."""
    import mmap

    from pyspark import SparkFiles

    with open(SparkFiles.get(name), "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
