"""The event log: JSON lines, append-only. A Python data source gives and takes whole lines, in Arrow batches, as a batch and
as a stream; what a line holds is decoded, checked and brought to its type's version by Spark.

A file that doesn't end in a line feed has an uncommitted last line, which is dropped (by bytes, so a character
cut in two does no harm). A committed line that can't be read, or has an unknown version, is an error.

`ordinal`, the order of the log, is the byte at which a line begins: so neither the driver nor a task has to know
what lies before its own range, and ranges of one file are read, and streamed, by many tasks. Errors name a line by
it; line_number() counts. Files are reached through pyarrow's file systems; appending needs a local or mounted one, as
it locks. segments.py has a log without a lock, in many files.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

SCHEMA = "ordinal long, envelope_version int, id string, stream string, seq long, type string, schema_version int, occurred_at timestamp, recorded_at timestamp, causation_id string, correlation_id string, payload string"
_REQUIRED = ["envelope_version", "id", "stream", "seq", "type", "schema_version", "occurred_at", "recorded_at", "correlation_id", "payload"]
SPLIT_BYTES = 32 << 20
_STEP = 1 << 16

_BLOCK = 4 << 20

#: What brings a payload (a VARIANT) of (type, version) to the next version.
Upcasts = dict[tuple[str, int], Callable[[Column], Column]]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _size(path: str) -> int:
    """Bytes of the file; 0 if there is none."""
    store, name = _store(path)
    info = store.get_file_info(name)
    return info.size if info.is_file else 0


def committed_end(path: str, least: int = 0) -> int:
    """The byte behind the last line feed, looked for from the end."""
    end = _size(path)
    if end <= least:
        return end if end < least else least
    store, name = _store(path)
    with store.open_input_file(name) as f:
        while end > least:
            at = max(least, end - _STEP)
            f.seek(at)
            found = f.read(end - at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            end = at
    return least


def blocks(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(byte, whole committed lines) of the lines that begin in [start, end); the last one may go on behind it."""
    store, name = _store(path)
    with store.open_input_file(name) as f:
        at, held = start, b""
        if start:  # a line that begins before is the range's before
            f.seek(start - 1)
            while (part := f.read(_STEP)) and (cut := part.find(b"\n")) < 0:
                at += len(part)
            if not part:
                return
            at, held = at + cut, part[cut + 1 :]
        while at < end:
            # the line with the range's last byte is the last one
            cut = held.find(b"\n", max(0, end - 1 - at)) if at + len(held) >= end else -1
            cut = held.rfind(b"\n") if cut < 0 else cut
            if cut < 0 or (at + len(held) < end and len(held) < _BLOCK):
                part = f.read(max(_STEP, len(held)))
                held += part
                if part:
                    continue
                if cut < 0:
                    return  # not committed
            yield at, held[: cut + 1]
            at, held = at + cut + 1, held[cut + 1 :]


def lines(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(byte, line) of the committed lines that begin in [start, end)."""
    for at, block in blocks(path, start, end):
        for line in block.split(b"\n")[:-1]:
            yield at, line
            at += len(line) + 1


def line_number(path: str, ordinal: int) -> int:
    """The number of the line that begins at this byte."""
    store, name = _store(path)
    n = 1
    with store.open_input_file(name) as f:
        while ordinal > 0 and (part := f.read(min(ordinal, 1 << 20))):
            n, ordinal = n + part.count(b"\n"), ordinal - len(part)
    return n


# -- what a line holds ------------------------------------------------------------------------------------

_ENVELOPE = SCHEMA.replace("ordinal long, ", "") + ", _bad string"


def _upcast(e: Column, upcasts: Upcasts, current: dict[str, int]) -> tuple[Column, Column, Column]:
    """(payload, its version, the version that its type is at) of an envelope."""
    payload, version = e["payload"], e["schema_version"]
    for kind, of in sorted(upcasts):
        due = (e["type"] == kind) & (version == of)
        payload, version = F.when(due, F.to_json(upcasts[kind, of](F.parse_json(payload)))).otherwise(payload), F.when(due, version + 1).otherwise(version)
    wanted = F.lit(1)
    for kind, v in current.items():
        wanted = F.when(e["type"] == kind, v).otherwise(wanted)
    return payload, version, wanted


def decoded(raw: DataFrame, upcasts: Upcasts | None = None, current: dict[str, int] | None = None, *keys: str) -> DataFrame:
    """Rows of SCHEMA from (ordinal, line, keys); blank lines give none. Older payloads are brought to the type's current
    version (1 if none is named). A line that isn't an event of a known version is an error, whatever is read of it."""
    text = F.col("line").cast("string")
    names = [c.split()[0] for c in SCHEMA.split(", ")][1:]

    def checked(e: Column) -> Column:
        payload, version, wanted = _upcast(e, upcasts or {}, current or {})
        missing = F.array_compact(F.array(*(F.when(e[k].isNull(), F.lit(k)) for k in _REQUIRED)))
        found = (
            F.when(~F.is_valid_utf8(text), "not UTF-8").when(e.isNull() | e["_bad"].isNotNull(), "not JSON of an event")
            .when(F.size(missing) > 0, F.concat(F.lit("fields are missing: "), F.array_join(missing, ", ")))
            .when((e["envelope_version"] != 1) | (version != wanted), F.concat(F.lit("unknown version "), e["envelope_version"].cast("string"), F.lit("/"), e["schema_version"].cast("string"), F.lit(" of "), e["type"]))
        )
        out = F.struct(*((payload if n == "payload" else version if n == "schema_version" else e[n]).alias(n) for n in names))
        error = F.raise_error(F.concat(F.lit("line at byte "), F.col("ordinal").cast("string"), F.lit(": "), found))
        return F.when(found.isNull(), out).otherwise(error.cast(_TYPE))

    one = F.from_json(text, _ENVELOPE, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    # rows come out of a generator, so that no projection passes over the check
    blank = F.length(F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))) == 0
    events = F.when(blank, F.array().cast(f"array<{_TYPE}>")).otherwise(F.transform(F.array(one), checked))
    return raw.select(*keys, "ordinal", F.inline(events))


_TYPE = "struct<" + ",".join(":".join(c.split()) for c in SCHEMA.split(", ")[1:]) + ">"


def encoded(events: DataFrame) -> DataFrame:
    """(line) of rows of SCHEMA: an event's JSON and a line feed; fields without a value are left out, a payload that isn't JSON is an error."""
    fields = [c.split()[0] for c in SCHEMA.split(", ")][1:-1]
    head = F.to_json(F.struct(*fields), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timeZone": "UTC"})
    payload = F.when(F.try_parse_json("payload").isNotNull(), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload of event "), "id", F.lit(" is not JSON"))))
    return events.select(F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"payload":'), F.regexp_replace(payload, "[\r\n]", " "), F.lit("}\n")).alias("line"))


# -- the source of lines ------------------------------------------------------------------------------------


class _Range(InputPartition):
    def __init__(self, at: int, end: int):
        self.at, self.end = at, end


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.since, self.until = int(options.get("since", 0)), int(options["until"]) if "until" in options else None

    def ranges(self, start: int, end: int):
        return [_Range(at, min(end, at + self.split)) for at in range(start, end, self.split)] or [_Range(0, 0)]

    def partitions(self):
        """Ranges of bytes, from the file's size alone."""
        end = _size(self.path)
        return self.ranges(self.since, end if self.until is None else min(end, self.until))

    def read(self, partition):
        if partition.at == partition.end:
            return
        for at, block in blocks(self.path, partition.at, partition.end):
            ends = np.flatnonzero(np.frombuffer(block, np.uint8) == 10) + 1
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            whole = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(block)])
            yield pa.RecordBatch.from_arrays([pa.array(offsets[:-1].astype(np.int64) + at), whole], ["ordinal", "line"])


class _StreamReader(_Reader, DataSourceStreamReader):
    """Offsets are committed bytes, so an uncommitted tail waits for its line feed; a backlog is read in ranges."""

    last = 0

    def initialOffset(self):
        return {"bytes": 0}

    def latestOffset(self):
        self.last = committed_end(self.path, self.last)
        return {"bytes": self.last}

    def partitions(self, start, end):
        return self.ranges(start["bytes"], end["bytes"])

    def commit(self, end):
        pass


class _Staged(WriterCommitMessage):
    def __init__(self, file: str):
        self.file = file


class _Writer(DataSourceArrowWriter):
    """Tasks put their lines in files beside the log; the driver's commit appends them, all or none."""

    def __init__(self, options):
        self.path, self.batch = options["path"], uuid.uuid4().hex
        self.as_of = int(options["asof"]) if "asof" in options else None

    def write(self, batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        file = f"{self.path}.{self.batch}-{context.partitionId()}-{context.taskAttemptId()}"
        with open(file, "wb") as f:
            for batch in batches:
                # lines lie behind one another in an Arrow column
                column = batch.column(0).cast(pa.large_binary())
                _, places, data = column.buffers()
                places = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
                if len(column):
                    f.write(memoryview(data)[places[0] : places[-1]])
        return _Staged(file)

    def commit(self, messages):
        try:
            with _locked(self.path, self.as_of) as log:
                for m in messages:
                    if m is not None:
                        with open(m.file, "rb") as f:
                            while part := f.read(1 << 20):
                                log.write(part)
        finally:
            self.abort(messages)

    def abort(self, messages):
        """Nothing that this batch has staged stays, files of attempts that failed included."""
        folder = os.path.dirname(self.path) or "."
        mine = f"{os.path.basename(self.path)}.{self.batch}-"
        for name in os.listdir(folder) if os.path.isdir(folder) else ():
            if name.startswith(mine):
                with contextlib.suppress(FileNotFoundError):
                    os.remove(os.path.join(folder, name))


class EventLines(DataSource):
    """format("eventlines").option("path", ...): (ordinal, line) of committed lines, to be read as a batch or a stream; lines to append.

    Options: splitbytes; since and until, bytes between which lines begin (batches); asof, the committed end that a
    writer's caller has read.
    """

    @classmethod
    def name(cls):
        return "eventlines"

    def schema(self):
        return "ordinal long, line binary"

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("a log is never overwritten")
        return _Writer(self.options)


def read(spark: SparkSession, path: str, upcasts: Upcasts | None = None, current: dict[str, int] | None = None, **options) -> DataFrame:
    """Rows of SCHEMA of a log's committed lines; none if there is no file."""
    spark.dataSource.register(EventLines)
    return decoded(spark.read.format("eventlines").options(path=path, **options).load(), upcasts, current)


def read_stream(spark: SparkSession, path: str, upcasts: Upcasts | None = None, current: dict[str, int] | None = None, **options) -> DataFrame:
    spark.dataSource.register(EventLines)
    return decoded(spark.readStream.format("eventlines").options(path=path, **options).load(), upcasts, current)


def write(events: DataFrame, path: str, as_of: int | None = None) -> None:
    """Append rows of SCHEMA, which have ids and sequence numbers, in the order of their partitions: one commit."""
    events.sparkSession.dataSource.register(EventLines)
    out = encoded(events).write.format("eventlines").option("path", path).mode("append")
    (out if as_of is None else out.option("asof", as_of)).save()


def stream_of(log: DataFrame, stream: str) -> DataFrame:
    return log.where(F.col("stream") == stream)


def overlay(log: DataFrame, more: DataFrame) -> DataFrame:
    """log with the rows of `more` behind it, in their own order: what a dry run reads; nothing is written."""
    last = log.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("_last"))
    shifted = more.crossJoin(F.broadcast(last)).withColumn("ordinal", F.col("ordinal") + F.col("_last") + 1).drop("_last")  # one row
    return log.unionByName(shifted, allowMissingColumns=True)


class Conflict(Exception):
    """Another writer has appended to the stream."""


def line_of(event: dict) -> bytes:
    time = lambda v: v.isoformat().replace("+00:00", "Z") + ("" if v.tzinfo else "Z") if isinstance(v, datetime) else v
    e = {k: time(v) for k, v in event.items() if v is not None and k != "ordinal"}
    if isinstance(e.get("payload"), str):
        e["payload"] = json.loads(e["payload"])
    return json.dumps(e, separators=(",", ":"), ensure_ascii=False).encode() + b"\n"


class _locked:
    """The log open for appending by this process alone, its torn tail cut off; synced at the end.

    as_of: the committed end that the caller has read; a log that has grown since is a conflict.
    """

    def __init__(self, path: str, as_of: int | None = None):
        self.path, self.as_of = path, as_of

    def __enter__(self):
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        self.f = open(self.path, "a+b")
        fcntl.flock(self.f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        self.end = committed_end(self.path)
        if self.as_of is not None and self.as_of != self.end:
            self.f.close()
            raise Conflict(f"the log has grown from {self.as_of} to {self.end} bytes")
        if self.end < _size(self.path):
            self.f.truncate(self.end)
        self.f.seek(0, 2)
        return self.f

    def __exit__(self, kind, *_):
        if kind is not None:  # half a batch is none
            with contextlib.suppress(OSError):
                self.f.flush()
            os.truncate(self.path, self.end)
        self.f.flush()
        os.fsync(self.f.fileno())
        self.f.close()


def append(path: str, events: list[dict], expected: dict[str, int], as_of: int = 0) -> int:
    """One commit by the driver: lock, cut a torn tail, check each stream's sequence, write at once, sync; the log's new end.

    expected: the last seq of each stream as it was when the committed end was `as_of`; only what was appended since
    is looked through, line by line.
    """
    with _locked(path) as f:
        last = dict(expected) if as_of else dict.fromkeys(expected, 0)
        end = committed_end(path)
        for at, line in lines(path, as_of, end) if end > as_of else ():
            if line.strip():
                e = json.loads(line)
                last[e["stream"]] = max(last.get(e["stream"], 0), e["seq"])
        for stream, seq in expected.items():
            if last.get(stream, 0) != seq:
                raise Conflict(f"{stream}: expected {seq}, found {last.get(stream, 0)}")
        raw = b"".join(map(line_of, events))
        if f.write(raw) != len(raw):
            raise OSError("short write")
        return end + len(raw)
