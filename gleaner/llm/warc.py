"""WARC archives: written with revisits, chunked HTTP framing and segments, and reassembled on reading.

A record whose block is longer than `segment` bytes is written as a first record (WARC-Segment-Number 1)
and continuations that name its identifier (WARC-Segment-Origin-ID); the last one has the total length.
Reading groups continuations by origin, orders them by number, verifies numbers and total length, and
decodes the chunked transfer framing. Every record is a gzip member of its own.

Defined cases: null html is the empty payload; of equal payloads the smallest page_id is the response (all
rows with that id, if it is repeated); null page_id counts as the largest; a damaged or incomplete group of
segments raises an error; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_key, settle, shared_dir, ship

SEGMENT_BYTES = 8192
CHUNK_BYTES = 4096
FILE_BYTES = 32 << 20
#: A digest of one in so many repeated rows, or more, is looked up in a broadcast.
HOT_SHARE = 1000
_EPOCH = "2024-01-01T00:00:00Z"

RECORDS = "page_key long, kind string, origin string, number int, total long, block binary, digest string, refers_key long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunked framing is damaged")
        out.append(body[at : at + n])
        at += n + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))]) + "\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def records_of(page: int, url: str, payload: bytes, refers: int | None, segment: int) -> list[bytes]:
    """The records of a page: one, or a first segment and its continuations."""
    digest = digest_of(payload)
    name = lambda k: f"<urn:page:{k}:{digest[:16]}>"
    base = [("WARC-Record-ID", name(page)), ("WARC-Date", _EPOCH), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers is not None:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [record([("WARC-Type", "revisit"), *base, ("WARC-Refers-To", name(refers)), ("WARC-Profile", profile)], http)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        return [record([("WARC-Type", "response"), *base], block)]
    out = [record([("WARC-Type", "response"), *base, ("WARC-Segment-Number", 1)], block[:segment])]
    for number, at in enumerate(range(segment, len(block), segment), 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name(page)[:-1]}:{number}>"), ("WARC-Date", _EPOCH), ("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", name(page)), ("WARC-Segment-Number", number)]
        if at + segment >= len(block):
            more.append(("WARC-Segment-Total-Length", len(block)))
        out.append(record(more, block[at : at + segment]))
    return out


def members(data: bytes, window: int = 1 << 15):
    """What each gzip member of an archive holds; compressed bytes are handed on in windows, from where the last member ended."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            part = view[at : at + window]
            if not len(part):
                raise ValueError("a gzip member ends early")
            out.append(z.decompress(part))
            at += len(part)
        at -= len(z.unused_data)
        yield b"".join(out)


def parse(data: bytes):
    """(headers with lower-case names, block) of every record of an archive."""
    for raw in members(data):
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        n = int(headers["content-length"])
        if len(rest) < n:
            raise ValueError("a record ends early")
        yield headers, rest[:n]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def with_types(pages: DataFrame, least: int = 0, hot_share: int = HOT_SHARE) -> DataFrame:
    """(page_id, page_key, url, payload, refers_key): refers_key is null for responses.

    Each repeated digest's smallest page is found by an aggregate that combines before the shuffle. Digests of at
    least one in `hot_share` of the repeated rows, so `hot_share` at most, are looked up in a broadcast; payloads
    of all others meet their digest's row in a join of which no key is that frequent.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), doc_key("page_id").alias("page_key"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b"")).alias("payload"))
    base = base.withColumn("digest", F.unhex(F.sha1("payload")))
    first = settle(base.groupBy("digest").agg(F.min("page_key").alias("first"), F.count("*").alias("n")).where("n > 1"))
    repeated = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") * hot_share >= repeated
    known = base.join(F.broadcast(first.where(is_hot).select("digest", F.col("first").alias("hot"))), "digest", "left")
    # rows that are done get keys of their own, so that they don't meet in one task
    at = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.encode(F.concat_ws(" ", "page_key", F.xxhash64("url")), "UTF-8"))
    found = known.withColumn("_at", at).join(first.where(~is_hot).select(F.col("digest").alias("_at"), "first"), "_at", "left").withColumn("first", F.coalesce("hot", "first"))
    refers = F.when((F.col("first") != F.col("page_key")) & (F.length("payload") >= least), F.col("first"))
    return found.withColumn("refers_key", refers).select("page_id", "page_key", "url", "payload", "refers_key")


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES, least: int = 0) -> DataFrame:
    """Write pages to .warc.gz files in `path`; (file, records, bytes) of each, already written.

    A file's name holds the attempt that wrote it: an attempt that is lost, or loses to another, leaves files that this
    list doesn't have. The list, not the folder, says what the archives are; it is settled with the attempts that won.
    """
    ship(pages.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        store, folder = _store(path)
        store.create_dir(folder, recursive=True)
        held, size, number, n = [], 0, 0, 0

        def flush():
            name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{number:04d}.warc.gz"
            with store.open_output_stream(f"{folder}/{name}", compression=None) as f:
                for x in held:
                    f.write(x)
            return pa.record_batch([pa.array([f"{path.rstrip('/')}/{name}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

        for batch in batches:
            for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for x in records_of(page, (url or "").replace("\r", "%0D").replace("\n", "%0A"), payload, refers, segment):
                    held.append(x)
                    size, n = size + len(x), n + 1
                if size >= FILE_BYTES:
                    yield flush()
                    held, size, number, n = [], 0, number + 1, 0
        if held:
            yield flush()

    return settle(with_types(pages, least).select("page_key", "url", "payload", "refers_key").mapInArrow(run, "file string, records long, bytes long"))


def read_records(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """One row for each record of the archives, which are rows with a `file`; blocks as they stand. A task reads a file at a time."""
    ship(spark)
    key = lambda x: int(x.split(":")[2].rstrip(">"))

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, name = _store(file)
                with store.open_input_stream(name, compression=None) as f:
                    data = f.read()
                rows = []
                for h, block in parse(data):
                    origin = h.get("warc-segment-origin-id") or h["warc-record-id"]
                    number = int(h.get("warc-segment-number", 0))
                    total = h.get("warc-segment-total-length")
                    refers = h.get("warc-refers-to")
                    rows.append((key(origin), h["warc-type"], origin, number, total and int(total), block, h.get("warc-payload-digest"), refers and key(refers)))
                    if len(rows) >= 1000:
                        yield _records(rows)
                        rows = []
                if rows:
                    yield _records(rows)

    files = archives.select("file")
    return files.repartition(max(1, files.count()), "file").mapInArrow(run, RECORDS)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.int64())
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in RECORDS.split(", ")])


def payload_of(block: bytes, kind: str) -> tuple[bytes, int]:
    """Payload and its full length: of a revisit, which has none, the length that its HTTP head states."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in head.lower().split(b"\r\n")[1:])
    if kind == "revisit":
        return b"", int(fields[b"content-length"])
    if fields.get(b"transfer-encoding") == b"chunked":
        body = unchunked(body)
    return body, len(body)


_JUDGED = "page_key long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_key long, origin string, number int, total long"
_JUDGED_KINDS = (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64())


def _judged(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(_JUDGED_KINDS)], names=[x.split()[0] for x in _JUDGED.split(", ")])


def _verified(page: int, kind: str, origin: str, block: bytes, digest: str | None, refers: int | None, payloads: bool) -> tuple:
    payload, n = payload_of(block, kind)
    stated = (digest or "").removeprefix("sha1:")
    if kind != "revisit" and stated != digest_of(payload):
        raise ValueError(f"{origin}: the digest differs")
    return page, payload if payloads else None, n, stated, kind, refers, origin, 0, None


def _joined(group: list[tuple], payloads: bool) -> list[tuple]:
    """The record of all its segments, in order of number, as often as the record itself is repeated."""
    page, _, _, digest, kind, refers, origin, number, _ = group[0]
    if number != 1 or kind == "continuation":
        raise ValueError(f"{origin}: no first segment")
    copies = sum(g[7] == 1 for g in group)  # a repeated row has the same identifier and the same segments
    group = group[::copies]
    block = b"".join(g[1] for g in group)
    if [g[7] for g in group] != [*range(1, len(group) + 1)] or group[-1][8] != len(block):
        raise ValueError(f"{origin}: segments are missing or their total length differs")
    return [_verified(page, kind, origin, block, digest, refers, payloads)] * copies


def reassemble(records: DataFrame, payloads: bool = True) -> DataFrame:
    """(page_key, payload, payload_bytes, payload_digest, record_type, refers_key) of whole records.

    Archives are read once: a record that isn't segmented is decoded and verified where it is read, and then travels
    with the segments (without its payload, if payloads are not asked for). Segments meet by origin and are streamed
    in order of number: a task holds those of one record at a time.
    """

    def first(batches):
        for batch in batches:
            rows, size = [], 0
            for page, kind, origin, number, total, block, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((page, block, None, digest, kind, refers, origin, number, total) if number else _verified(page, kind, origin, block, digest, refers, payloads))
                size += len(rows[-1][1] or b"")
                if size > 8 << 20:
                    yield _judged(rows)
                    rows, size = [], 0
            yield _judged(rows)

    def second(batches):
        group: list[tuple] = []
        for batch in batches:
            whole = pc.equal(batch.column(7), 0)
            known = batch.filter(whole)
            yield pa.record_batch(known.columns, names=known.schema.names)  # without the plan's notes on nulls
            done, size = [], 0
            for row in zip(*(c.to_pylist() for c in batch.filter(pc.invert(whole)).columns), strict=True):
                if group and row[6] != group[0][6]:
                    done += _joined(group, payloads)
                    size += len(done[-1][1] or b"")
                    group = []
                group.append(row)
                if size > 8 << 20:
                    yield _judged(done)
                    done, size = [], 0
            yield _judged(done)
        if group:
            yield _judged(_joined(group, payloads))

    return records.mapInArrow(first, _JUDGED).repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(second, _JUDGED).drop("origin", "number", "total")


def round_trip(pages: DataFrame, segment: int = SEGMENT_BYTES, least: int = 0) -> DataFrame:
    """Write, read back, and tell for each page row what its record says."""
    spark = pages.sparkSession
    path = shared_dir(spark)
    archives = write_archives(pages, path, segment, least)
    if not archives.limit(1).count():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    found = reassemble(read_records(spark, archives), payloads=False)
    null = F.lit(2**63 - 1)
    back = lambda c: F.when(F.col(c) != null, F.col(c))
    return found.select(back("page_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", back("refers_key").alias("refers_to"))
