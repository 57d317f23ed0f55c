"""Substring dedup over super-k-mers.

A window is `width` consecutive words of one document. Each window has a minimiser: of its word pairs, the
one with the least hash. Consecutive windows with the same minimiser travel as one packed string of words
to the minimiser's bucket, so equal windows meet in one bucket. There the windows are sorted and equal
neighbours, whose words are compared, are counted exactly; every one but the earliest is a repeat.

What is earlier within a task's share is found before anything travels: a window that already started
earlier in the share is a repeat for certain and only the earliest goes on. A passage that a third of all
documents share therefore reaches its bucket once for each share, not once for each document.

Defined cases: null and empty texts have no words; fewer words than `width` have no window and stay whole;
null doc_id counts as the largest; rows that repeat doc_id and text are one document, judged once, with a
result row each; rows that share doc_id only are ordered, and told apart, by a 64-bit hash of their texts (of 10^7 different
texts with one id, null for instance, two have the same one with a chance of 3e-6); an empty table gives an
empty result. Other columns are ignored. A text of any length is looked through in slices of SHARE_BYTES.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import asked, bitmap, doc_key, hash_words, mix, places, runs, settle, ship, trim

WIDTH = 20
#: Words that a minimiser spans.
SEED_WORDS = 2
#: Text that a task looks through at once before it sends; bounds its memory.
SHARE_BYTES = 4 << 20
#: Packed text that a bucket is meant to hold.
BUCKET_BYTES = 4 << 20
#: Packed text beyond which a bucket's windows go on to other buckets.
HOT_BYTES = 32 << 20


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Least of every k consecutive values, in log k passes."""
    done = 1
    while done < k:
        step = min(done, k - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def windows_in(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with `lengths` words laid end to end: (text, start in the text, place) of every window within one."""
    n = np.maximum(lengths - width + 1, 0)
    text = np.repeat(np.arange(len(lengths)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return text, start, start + np.repeat(np.cumsum(lengths) - lengths, n)


def repeats(h: np.ndarray, doc: np.ndarray, start: np.ndarray, place: np.ndarray, words: list[bytes], width: int) -> np.ndarray:
    """Which windows aren't the earliest of their words. doc: the document's order; place: of the first word in words."""
    order = np.lexsort((start, doc, h))
    hs = h[order]
    same = np.concatenate([[False], hs[1:] == hs[:-1]])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(hs))))  # the earliest of each run of equal hashes
    i, j = order[same], order[head[same]]
    other = (doc[i] != doc[j]) | (start[i] != start[j])
    i, j, run = i[other], j[other], head[same][other]
    out = np.zeros(len(h), bool)
    back = np.argsort(i, kind="stable")
    i, p, q, run = i[back], place[i[back]], place[j[back]], run[back]
    # neighbours that repeat neighbours are compared at once, word by word
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(p) != 1) | (np.diff(q) != 1)])) if len(i) else np.empty(0, int)
    strays: dict[int, list[int]] = {}
    for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(i)][: len(cut)], strict=True):
        n = z - a + width - 1
        if words[p[a] : p[a] + n] == words[q[a] : q[a] + n]:
            out[i[a:z]] = True
            continue
        for k in range(a, z):
            own = words[p[k] : p[k] + width]
            if own == words[q[k] : q[k] + width]:
                out[i[k]] = True
            else:  # two texts with one hash: compare with the others of the run that differ from the earliest
                strays.setdefault(int(run[k]), []).append(k)
    for ks in strays.values():
        firsts: list[list[bytes]] = []
        for k in sorted(ks, key=lambda k: (doc[i[k]], start[i[k]])):
            own = words[p[k] : p[k] + width]
            if own in firsts:
                out[i[k]] = True
            else:
                firsts.append(own)
    return out


def _ranges(mask: np.ndarray, text: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, from, to) of the runs of true windows within a text; `to` is excluded."""
    at = np.flatnonzero(mask)
    if not len(at):
        return []
    cut = np.concatenate([[True], (np.diff(at) != 1) | (text[at[1:]] != text[at[:-1]])])
    head = at[cut]
    tail = at[np.append(np.flatnonzero(cut)[1:] - 1, len(at) - 1)]
    return list(zip(text[head].tolist(), start[head].tolist(), (start[tail] + 1).tolist(), strict=True))


_SENT = "bucket int, packed binary, doc long, text_hash long, first long, last long"
_KINDS = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], names=[x.split()[0] for x in _SENT.split(", ")])


def slices(text: str | None, most: int, lap: int):
    """(number of the first word, words, words again in the next slice) of a text, parted at blanks about every `most`
    bytes; neighbours share `lap` words, so that each window of lap + 1 words lies in just one slice."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    if len(raw) <= most:
        yield 0, raw.split(), 0
        return
    base, at, left = 0, 0, []
    while at < len(raw):
        end = at + most
        if end < len(raw):
            blank = BLANK(raw, end)
            end = blank.end() if blank else len(raw)
        words, at = left + raw[at:end].split(), end
        left = words[-lap:] if at < len(raw) and lap else []
        yield base, words, len(left)
        base += len(words) - len(left)


BLANK = re.compile(rb"[\x20\x09-\x0d]").search


def _send(share: list[tuple], width: int, seed_words: int, buckets: int):
    """Rows of a share of documents' slices (doc, text_hash, first word, words): repeats found here, and the packed
    super-k-mers that travel, by bucket."""
    share.sort(key=lambda d: d[:3])
    kept, last = [], None
    for d in share:
        if d[:3] != last and len(d[3]) >= width:
            kept.append(d)
        last = d[:3]
    if not kept:
        return
    words = [w for d in kept for w in d[3]]
    h = hash_words(b" ".join(words))
    text, start, place = windows_in(np.array([len(d[3]) for d in kept]), width)
    docs, text_hashes, bases = (np.array([d[i] for d in kept], np.int64)[text] for i in range(3))
    repeat = repeats(runs(h, width)[place], text, start, place, words, width)
    # found already: any bucket hands them on, so copies of one text are dealt by their ids and places too
    rows = [(hash((*kept[t][:2], a)) % buckets, None, *kept[t][:2], kept[t][2] + a, kept[t][2] + b) for t, a, b in _ranges(repeat, text, start)]
    rows += _parcels(words, h, text, bases + start, place, ~repeat, docs, text_hashes, width, _seeds(width, seed_words)[0], buckets)
    for i in range(0, len(rows), 2000):
        yield _batch(rows[i : i + 2000])


def _seeds(width: int, seed_words: int) -> list[tuple[int, int]]:
    """(words that a minimiser spans, seed of its order) by level; the last one is the window itself."""
    return [(seed_words, 3), (max(seed_words, width // 3), 5), (width, 9)]


def _parcels(words: list[bytes], h: np.ndarray, text: np.ndarray, start: np.ndarray, place: np.ndarray, new: np.ndarray, docs: np.ndarray, text_hashes: np.ndarray, width: int, seed: tuple[int, int], buckets: int) -> list[tuple]:
    """Super-k-mers of the windows that are new, packed by bucket; the arrays have a value for each window."""
    least = sliding_min(runs(h, seed[0], seed=seed[1]), width - seed[0] + 1)[place]
    # a super-k-mer ends where the minimiser or the text changes, or a window isn't new
    cut = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (new[1:] != new[:-1])]))
    end = np.append(cut[1:], len(least))
    fresh = new[cut]
    cut, end = cut[fresh], end[fresh]
    target = (mix(least[cut]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(target, kind="stable")
    cut, n, target = cut[order], (end - cut)[order] + width - 1, target[order]
    start, place, docs, text_hashes = start[cut], place[cut], docs[cut], text_hashes[cut]
    lines = [b" ".join(words[p : p + m]) for p, m in zip(place.tolist(), n.tolist(), strict=True)]
    edge = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.empty(0, int)
    pack = zstandard.ZstdCompressor(level=3).compress
    rows = []
    for a, z in zip(edge.tolist(), [*edge[1:].tolist(), len(target)][: len(edge)], strict=True):
        head = np.array([z - a], "<i8").tobytes() + b"".join(x[a:z].astype("<i8").tobytes() for x in (docs, text_hashes, start)) + n[a:z].astype("<i4").tobytes()
        rows.append((int(target[a]), pack(head + b" ".join(lines[a:z])), None, None, None, None))
    return rows


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, seed_words: int = SEED_WORDS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(doc, text_hash, first, last): runs of windows, by their first words, that start earlier elsewhere.

    A bucket beyond hot_bytes is never held: its windows go on, by share, to buckets of a longer minimiser in another
    order, and those of one that is still too large to buckets of the windows themselves. Nothing else takes that way.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(doc_key(key).alias("doc"), _text_hash(text).alias("text_hash"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    size = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(8, int(size * 3 / BUCKET_BYTES))
    seeds = _seeds(width, seed_words)

    def scan(batches):
        share, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for doc, text_hash, x in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True):
                    for first, words, _ in slices(x, SHARE_BYTES, width - 1):
                        share.append((doc, text_hash, first, words))
                        size += min(len(x), SHARE_BYTES)
                        if size > SHARE_BYTES:
                            yield from _send(share, width, seed_words, buckets)
                            share, size = [], 0
        yield from _send(share, width, seed_words, buckets)
        trim()

    def judge(batches, level):
        """A partition may hold several buckets; each is judged whole when the next one begins, unless it is hot."""
        onward = (seeds[level + 1], buckets) if level + 1 < len(seeds) else None
        held: list[bytes] = []
        at, size, hot = None, 0, False
        for batch in batches:
            known = batch.filter(batch.column(1).is_null())
            yield pa.record_batch(known.columns, names=known.schema.names)  # without the plan's notes on nulls
            batch = batch.filter(batch.column(1).is_valid())
            for b, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != at:
                    yield from _judge(held, width, onward if hot else None)
                    held, at, size, hot = [], b, 0, False
                held.append(packed.as_py())
                size += zstandard.frame_content_size(held[-1])
                if onward and size > (min(SHARE_BYTES, hot_bytes) if hot else hot_bytes):
                    hot = True
                    yield from _judge(held, width, onward)
                    held, size = [], 0
        yield from _judge(held, width, onward if hot else None)
        trim()

    sent, out = source.mapInArrow(scan, _SENT), []
    for level in range(len(seeds)):
        judged = settle(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda x, at=level: judge(x, at), _SENT))
        out.append(judged.where("packed is null").select("doc", "text_hash", "first", "last"))
        sent = judged.where("packed is not null")
        if level + 1 == len(seeds) or sent.isEmpty():
            return functools.reduce(DataFrame.union, out)
    raise AssertionError("not reached")


def _judge(packed: list[bytes], width: int, onward: tuple[tuple[int, int], int] | None = None):
    """Repeats among the packed windows; with onward (seed, buckets) also the others, packed for their next buckets."""
    if not packed:
        return
    unpack = zstandard.ZstdDecompressor().decompress
    heads, texts = [], []
    for blob in packed:
        raw = unpack(blob)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        heads.append((*(np.frombuffer(raw, "<i8", n, 8 + 8 * n * i) for i in range(3)), np.frombuffer(raw, "<i4", n, 8 + 24 * n).astype(np.int64)))
        texts.append(raw[8 + 28 * n :])
    raw = b" ".join(texts)
    words = raw.split(b" ")
    doc, text_hash, first, lengths = map(np.concatenate, zip(*heads, strict=True))
    text, start, place = windows_in(lengths, width)
    order = np.lexsort((text_hash, doc))
    number = np.empty(len(doc), np.int64)
    number[order] = np.cumsum(np.concatenate([[0], (np.diff(doc[order]) != 0) | (np.diff(text_hash[order]) != 0)]))
    h = hash_words(raw)
    repeat = repeats(runs(h, width)[place], number[text], first[text] + start, place, words, width)
    rows = [(None, None, int(doc[t]), int(text_hash[t]), int(first[t]) + a, int(first[t]) + b) for t, a, b in _ranges(repeat, text, start)]
    if onward:
        rows += _parcels(words, h, text, first[text] + start, place, ~repeat, doc[text], text_hash[text], width, *onward)
    step = 2_000 if onward else 20_000
    for i in range(0, len(rows), step):
        yield _batch(rows[i : i + step])


def kept_of(text: str | None, ranges: list[tuple[int, int]], width: int):
    """(number of words, kept words) of each slice of a text; ranges: runs of windows by first word, `last` excluded."""
    cover = np.array([(a, b + width - 1) for a, b in ranges], np.int64).reshape(-1, 2)
    for base, words, _ in slices(text, SHARE_BYTES, 0):
        own = cover[(cover[:, 0] < base + len(words)) & (cover[:, 1] > base)]
        if len(own):
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, np.maximum(own[:, 0] - base, 0), 1)
            np.add.at(edge, np.minimum(own[:, 1] - base, len(words)), -1)
            yield len(words), [w for w, gone in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not gone]
        else:
            yield len(words), words


def _text_hash(text: str):
    """Tells rows apart that share an id."""
    return F.xxhash64(text)


def _found(docs: DataFrame, key: str, text: str, width: int, seed_words: int, hot_bytes: int) -> DataFrame:
    """(doc, text_hash, ranges): repeated windows of each document that has any, written to the shared folder."""
    return settle(repeated_windows(docs, key, text, width, seed_words, hot_bytes).groupBy("doc", "text_hash").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("ranges")))


def _digests(text: str | None, ranges: list[tuple[int, int]], width: int) -> tuple[int, int, str]:
    sha, n, stay = hashlib.sha256(), 0, 0
    for size, kept in kept_of(text, ranges, width):
        if kept:
            sha.update((b" " if stay else b"") + b" ".join(kept))
        n, stay = n + size, stay + len(kept)
    return n, n - stay, sha.hexdigest()


def dedup_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, seed_words: int = SEED_WORDS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) for each row.

    Rows that the bitmap of documents with repeats rules out are done where they are read; only the others' texts
    travel to their ranges.
    """
    found = _found(docs, key, text, width, seed_words, hot_bytes)
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(found))
    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text"), doc_key(key).alias("doc"), _text_hash(text).alias("text_hash"))

    def first(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                hit, out = asked(bits.value, part.columns[4:7]).tolist(), []
                for x, h in zip(part.column(1).to_pylist(), hit, strict=True):
                    out.append((None, None, None, x) if h else (*_digests(x, [], width), None))
                yield pa.record_batch([part.column(0), part.column(2), part.column(3), *(pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string())))], names=[key, "doc", "text_hash", "n_words", "n_removed", "kept_sha256", "text"])

    def second(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part, out = batch.slice(at, 200), []
                for x, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    out.append(_digests(x, [(r["first"], r["last"]) for r in ranges or ()], width))
                yield pa.record_batch([part.column(0), *(pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string())))], names=names)

    names = [key, "n_words", "n_removed", "kept_sha256"]
    schema = f"{key} long, n_words long, n_removed long, kept_sha256 string"
    spot = [p.alias(f"p{i}") for i, p in enumerate(places())]
    seen = settle(rows.select("*", *spot).mapInArrow(first, f"{key} long, doc long, text_hash long, n_words long, n_removed long, kept_sha256 string, text string"))
    rest = seen.where("n_words is null").join(found, ["doc", "text_hash"], "left").select(key, "text", "ranges").mapInArrow(second, schema)
    return seen.where("n_words is not null").select(*names).union(rest)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, seed_words: int = SEED_WORDS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """docs with repeated passages cut out of text. Texts without one stay as they are, blanks included;
    of others the kept words are joined by one space. Other columns, of any name, pass through.

    Rows that the bitmap of documents with repeats rules out don't travel.
    """
    spark = docs.sparkSession
    found = _found(docs, key, text, width, seed_words, hot_bytes)
    bits = spark.sparkContext.broadcast(bitmap(found))
    names = {c: f"_{i}_" for i, c in enumerate(docs.columns)}
    at = names[next(c for c in docs.columns if c.lower() == text.lower())]

    @F.pandas_udf("boolean")
    def may(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(asked(bits.value, [pa.array(x) for x in (a, b, c)]))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        whole = lambda x, r: b" ".join(b" ".join(k) for _, k in kept_of(x, [(a["first"], a["last"]) for a in r], width) if k).decode("utf-8", "surrogatepass")
        return pd.Series([x if r is None or x is None else whole(x, r) for x, r in zip(texts, ranges, strict=True)])

    keyed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), doc_key(key).alias("doc"), _text_hash(text).alias("text_hash"))
    keyed = keyed.withColumn("may", may(*places()))
    joined = keyed.where("may").join(found, ["doc", "text_hash"], "left")
    done = joined.withColumn(at, F.when(F.col("ranges").isNull(), F.col(at)).otherwise(cut(F.col(at), F.col("ranges"))))
    back = [F.col(n).alias(c) for c, n in names.items()]
    return keyed.where("not may").select(*back).union(done.select(*back))
