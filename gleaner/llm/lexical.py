"""Ranked lexical search over a bit-sliced impact index.

Documents lie in blocks, ascending by id. For each term of a block the index has a bitmap of the documents that hold
it, and one bitmap for each bit of their impacts (weight times saturated frequency, an integer), over these documents.
A block's scores are slices too: a term's slices are added to those of all items that ask for it by bitwise carry
arithmetic, 64 documents to a word. The best are found from the most significant slice down: documents that are surely
above the k-th, and those that tie with it so far, narrowed by each slice. Scores are read from the slices at the end.

The texts are read once, for frequencies of terms that an item asks for; weights need all documents, so impacts are
sliced from what that pass wrote. Items are asked in bounded lots, all over the whole index.

Defined cases: a null text, or one without a term, is no document and ranks nowhere; an item without a term, or whose
terms no document holds, has no rows; rows with equal ids are documents (and items) of their own, a null id comes last
among equal scores; empty tables give no rows. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, ship

#: Terms are runs of ASCII letters and digits, and of all that lies beyond ASCII; only A-Z are lower-cased.
_SPACED = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
_STEP = 1 << 20

TOP = 50
BLOCK_DOCS = 16_384
#: A block's postings lie in memory at once.
BLOCK_POSTINGS = 4_000_000
#: Items of one task's slices.
GROUP_ITEMS = 256
#: Pairs of items and terms, and bytes of them, that are asked for at a time: these are what a lot broadcasts.
LOT_PAIRS, LOT_BYTES = 200_000, 16 << 20

_FORWARD = "doc_id long, n long, terms array<int>, counts array<int>"
_INDEX = "block int, term int, docs int, exists binary, slices binary"
_FOUND = "item int, item_id long, block int, doc_id long, score long"


def parts_of(text: bytes):
    """Lists of the terms of a text, a million bytes or so at a time."""
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + _STEP)
        part = text[at:end].translate(_SPACED)
        while end < n and part[-1:] != b" ":  # a term isn't cut
            more = text[end : end + 4096].translate(_SPACED)
            cut = more.find(b" ")
            cut = len(more) if cut < 0 else cut + 1
            part, end = part + more[:cut], end + cut
        yield part.split()
        at = end


def _forward(vocabulary: dict[bytes, int]):
    """(doc_id, n, terms, counts) of batches (doc_id, text): n counts all terms, the rest those of the vocabulary."""

    def run(batches):
        import pyarrow as pa

        get = vocabulary.get
        for batch in batches:
            ids, sizes, terms, counts = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, found = 0, Counter()
                for words in parts_of(text.as_py() or b""):
                    n += len(words)
                    found.update(map(get, words))
                found.pop(None, None)
                if n:
                    ids.append(doc), sizes.append(n), terms.append(list(found)), counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "counts"])

    return run


def _item_terms(batches):
    import pyarrow as pa

    for batch in batches:
        found = [sorted({w for words in parts_of(t or b"") for w in words}) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


@dataclass
class Stats:
    """docs with a term, all their terms, and each asked term's weight."""

    docs: int
    terms: int
    weights: np.ndarray

    def impacts(self, term: int, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 50 + 50 * n * self.docs // self.terms
        return self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def sliced(values: np.ndarray) -> np.ndarray:
    """Bitmaps of the values' bits, the least significant first."""
    bits = int(values.max()).bit_length()
    return np.packbits((values[None, :] >> np.arange(bits)[:, None]) & 1 == 1, axis=1)


def _block_rows(block: int, ids: list, sizes: list, terms: list, counts: list, stats: Stats):
    """A block's rows of the index: its documents' ids under term -1, then one for each term."""
    known = np.array([i for i in ids if i is not None], "<i8")  # null ids lie last
    yield block, -1, len(ids), known.tobytes(), None
    place = np.repeat(np.arange(len(ids)), [len(t) for t in terms])
    term, tf, n = (np.concatenate(x) if x else np.empty(0, np.int64) for x in ([np.asarray(t, np.int64) for t in terms], [np.asarray(c, np.int64) for c in counts], [np.full(len(t), s, np.int64) for t, s in zip(terms, sizes, strict=True)]))
    order = np.argsort(term, kind="stable")
    term, tf, n, place = term[order], tf[order], n[order], place[order]
    edges = np.flatnonzero(np.diff(term, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        values = stats.impacts(int(term[a]), tf[a:b], n[a:b])
        if values.max() > 0:
            exists = np.zeros(len(ids), bool)
            exists[place[a:b]] = True
            yield block, int(term[a]), len(ids), np.packbits(exists).tobytes(), sliced(values).tobytes()


def _batches(rows, types, size: int = 256):
    import pyarrow as pa

    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), types, strict=True)], [k for k, _ in types])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), types, strict=True)], [k for k, _ in types])


def build(forward: DataFrame, stats, postings: int, rows: int) -> DataFrame:
    """The settled index of settled rows (doc_id, n, terms, counts). stats: a broadcast Stats."""
    import pyarrow as pa

    blocks = max(1, -(-rows // BLOCK_DOCS), -(-postings // BLOCK_POSTINGS))
    # any dealing is right; rows are numbered as they lie in files, so equal ones are dealt apart and the same way again
    dealt = forward.where(F.size("terms") > 0).withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    dealt = dealt.repartition(blocks, "block").sortWithinPartitions("block", F.col("doc_id").asc_nulls_last()).select("block", "doc_id", "n", "terms", "counts")
    types = [("block", pa.int32()), ("term", pa.int32()), ("docs", pa.int32()), ("exists", pa.binary()), ("slices", pa.binary())]

    def rows_of(batches):
        at, held = None, ([], [], [], [])
        for batch in batches:
            of = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    if at is not None and of[a] != at:
                        yield from _block_rows(at, *held, stats.value)
                        held = ([], [], [], [])
                    at = int(of[a])
                    held[0].extend(batch.column(1)[a:b].to_pylist())
                    held[1].extend(batch.column(2)[a:b].to_pylist())
                    for i in (3, 4):  # arrays stay small integers in numpy
                        held[i - 1].extend(x.values.to_numpy() for x in batch.column(i)[a:b])
        if at is not None:
            yield from _block_rows(at, *held, stats.value)

    return settle(dealt.mapInArrow(lambda batches: _batches(rows_of(batches), types), _INDEX))


def spread(exists: bytes, slices: bytes, docs: int) -> np.ndarray:
    """A term's slices over all documents of the block, in words of 64 documents."""
    places = np.flatnonzero(np.unpackbits(np.frombuffer(exists, np.uint8), count=docs))
    packed = np.frombuffer(slices, np.uint8).reshape(-1, -(-len(places) // 8))
    full = np.zeros((len(packed), -(-docs // 64) * 64), np.uint8)
    full[:, places] = np.unpackbits(packed, axis=1, count=len(places))
    return np.packbits(full, axis=1).view(np.uint64)


def add(sums: np.ndarray, items: np.ndarray, slices: np.ndarray) -> None:
    """sums (slices x items x words) of these items, plus a term's slices: a ripple of carries from the lowest bit up."""
    carry = np.zeros((len(items), sums.shape[2]), np.uint64)
    for i in range(len(sums)):
        a = sums[i, items]
        if i < len(slices):
            x = a ^ slices[i]
            sums[i, items] = x ^ carry
            carry = a & slices[i] | x & carry
        elif carry.any():
            sums[i, items] = a ^ carry
            carry &= a
        else:
            return
    if carry.any():
        raise OverflowError("a score needs more slices")


def best(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each item, bitmaps of documents surely among the k highest scores above 0, and of those that tie for the places left."""
    sure, tied = np.zeros(sums.shape[1:], np.uint64), np.bitwise_or.reduce(sums, axis=0)
    for s in sums[::-1]:
        with_bit = tied & s
        n = np.bitwise_count(sure | with_bit).sum(axis=1)[:, None]
        # too many have the bit: it is needed; else all that have it are in
        sure = np.where(n > k, sure, sure | with_bit)
        tied = np.where(n > k, with_bit, np.where(n < k, tied & ~s, np.uint64(0)))
    return sure, tied


def scores(sums: np.ndarray, item: int, places: np.ndarray) -> np.ndarray:
    """The scores of some documents, read from an item's slices."""
    raw = np.ascontiguousarray(sums[:, item]).view(np.uint8)[:, places >> 3]
    bits = (raw >> (7 - (places & 7)).astype(np.uint8)) & 1
    return (bits.astype(np.int64) << np.arange(len(sums))[:, None]).sum(axis=0)


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8)))


def _answers(block: int, ids: np.ndarray, sums: np.ndarray, numbers: list, k: int):
    sure, tied = best(sums, k)
    for i, (no, item_id) in enumerate(numbers):
        places = _places(sure[i])
        places = np.concatenate([places, _places(tied[i])[: k - len(places)]])
        for p, s in zip(places.tolist(), scores(sums, i, places).tolist(), strict=True):
            yield no, item_id, block, int(ids[p]) if p < len(ids) else None, s


def answers(index: DataFrame, groups, wanted: DataFrame, width: int, k: int) -> DataFrame:
    """(item, item_id, block, doc_id, score): each block's best for each item.

    groups: a broadcast list of (numbers of the items, {term: places of items in the group}); wanted: (term, group), a
    row for each term that a group asks for, and for -1. width: slices that the largest score can need.
    """
    import pyarrow as pa

    types = [("item", pa.int32()), ("item_id", pa.int64()), ("block", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())]
    dealt = index.join(F.broadcast(wanted), "term").repartition("block", "group").sortWithinPartitions("block", "group", "term").select("block", "group", "term", "docs", "exists", "slices")

    def rows_of(batches):
        at = None
        for batch in batches:
            for block, group, term, docs, exists, slices in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if term < 0:
                    if at is not None:
                        yield from _answers(at, ids, sums, numbers, k)
                    at, ids, (numbers, asking) = block, np.frombuffer(exists, "<i8"), groups.value[group]
                    sums = np.zeros((width, len(numbers), -(-docs // 64)), np.uint64)
                else:
                    add(sums, asking[term], spread(exists, slices, docs))
        if at is not None:
            yield from _answers(at, ids, sums, numbers, k)

    return dealt.mapInArrow(lambda batches: _batches(rows_of(batches), types, 4096), _FOUND)


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _lot(docs: DataFrame, items: list, k: int) -> DataFrame:
    """All documents ranked for the rows (item_id, terms) of one lot."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in items for t in r["terms"]}))}
    forward = settle(docs.mapInArrow(_forward(vocabulary), _FORWARD))
    n, total, rows = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.size("terms") > 0)).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, holds in forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term of the lot
        df[term] = holds
    weights = np.array([weight(n, int(d)) if d else 0 for d in df], np.int64)
    index = build(forward, spark.sparkContext.broadcast(Stats(n, total, weights)), int(df.sum()), rows)
    groups, wanted, width = [], [], 1
    for at in range(0, len(items), GROUP_ITEMS):
        part, asking = items[at : at + GROUP_ITEMS], {}
        for i, r in enumerate(part):
            terms = [vocabulary[bytes(t)] for t in r["terms"]]
            width = max(width, (int(weights[terms].sum()) * 1_000_000).bit_length())
            for t in terms:
                asking.setdefault(t, []).append(i)
        wanted += [(t, len(groups)) for t in [-1, *asking]]
        groups.append(([(at + i, r["item_id"]) for i, r in enumerate(part)], {t: np.array(x) for t, x in asking.items()}))
    found = answers(index, spark.sparkContext.broadcast(groups), spark.createDataFrame(wanted, "term int, group int"), width, k)
    # each item's best of some blocks first: no task gets all blocks of an item
    few = _top(found.withColumn("_some", F.pmod(F.hash("block"), F.lit(64))), ["item", "_some"], k).drop("rank", "_some")
    return _top(few, ["item"], k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 for each row of items."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(query_col).cast("string").cast("binary").alias("text"))
    asked = settle(asked.mapInArrow(_item_terms, "item_id long, terms array<binary>").where(F.size("terms") > 0))
    held = F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t))
    pairs, size = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)), F.coalesce(F.sum(held), F.lit(0))).first()
    lots = max(1, -(-pairs // LOT_PAIRS), -(-size // LOT_BYTES))
    dealt = asked.withColumn("_lot", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(lots)))
    out = None
    for lot in range(lots):
        found = _lot(docs, dealt.where(F.col("_lot") == lot).select("item_id", "terms").collect(), k)
        out = found if out is None else out.union(found)
    return out
