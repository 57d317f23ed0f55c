"""The event log as segments: one for each append, written by tasks side by side and committed by number, without a lock.

Below its folder, `data` has a folder of Parquet files for each batch, in the log's order, and `commits` a record for
each segment: its batch, its rows, the types that it has, and a Bloom filter of its streams. An event's `ordinal` is
its segment's number, then its place there. A scan of one stream or of some types opens only segments that may hold
them; within these Spark prunes by the bounds and Bloom filters that Parquet keeps for each row group.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commits, eventlog
from .commits import Conflict

__all__ = ["Conflict", "append", "last", "read", "segments"]

COLUMNS = [c.split()[0] for c in eventlog.SCHEMA.split(", ")]
_RECORD = "n long, batch string, rows long, types array<string>, bits int, words map<string,long>, apps map<string,long>"

#: An ordinal is a segment's number and 40 bits, of which 26 are a row's place in its partition.
PLACE_BITS, ROW_BITS = 40, 26
#: A segment's filter has ten bits for each stream, but these at least and at most.
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 20
#: So many types are named; a segment with more may hold any.
MOST_TYPES = 200


def _places(value: Column, bits: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), value), bits) for i in range(3)]


def last(spark: SparkSession, root: str) -> int:
    """The number of the last segment; 0 of an empty log."""
    return commits.last(spark, f"{root}/commits")


def _folder(root: str, batch: str) -> str:
    return f"{root}/data/{batch}"


def segments(spark: SparkSession, root: str, since: int = 1, until: int | None = None, stream: str | None = None, types: list[str] | None = None) -> DataFrame:
    """Records (n, batch, rows) of segments since to until that may hold events of the stream and of one of the types."""
    top = last(spark, root) if until is None else until
    files = [commits.file_of(f"{root}/commits", n) for n in range(since, top + 1)]
    if not files:
        return spark.createDataFrame([], _RECORD).select("n", "batch", "rows")
    found = spark.read.schema(_RECORD).json(files)
    if stream is not None:
        held = [_has_bit(p) for p in _places(F.lit(stream), F.col("bits"))]
        found = found.where(reduce(lambda a, b: a & b, held))
    if types is not None:
        found = found.where(F.col("types").isNull() | F.arrays_overlap("types", F.array(*map(F.lit, types))))
    return found.select("n", "batch", "rows")


def _has_bit(p: Column) -> Column:
    word = F.coalesce(F.try_element_at("words", F.floor(p / 64).cast("string")), F.lit(0).cast("long"))
    return F.call_function("getbit", word, (p % 64).cast("int")) == 1


def read(spark: SparkSession, root: str, since: int = 1, until: int | None = None, stream: str | None = None, types: list[str] | None = None) -> DataFrame:
    """Rows of eventlog.SCHEMA; since and until are numbers of segments."""
    found = sorted(r.batch for r in segments(spark, root, since, until, stream, types).collect())
    rows = spark.read.schema(eventlog.SCHEMA).parquet(*(_folder(root, b) for b in found)) if found else spark.createDataFrame([], eventlog.SCHEMA)
    if stream is not None:
        rows = rows.where(F.col("stream") == stream)
    return rows if types is None else rows.where(F.col("type").isin(types))


def _record(staged: DataFrame, batch: str) -> dict | None:
    """What is said of a staged batch; None of an empty one."""
    facts = staged.agg(F.count("*").alias("rows"), F.approx_count_distinct("stream").alias("streams"), F.max(F.col("ordinal").bitwiseAND((1 << PLACE_BITS) - 1)).alias("top")).first()
    if not facts.rows:
        return None
    types = [r.type for r in staged.select("type").distinct().limit(MOST_TYPES + 1).collect()]
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (10 * facts.streams - 1).bit_length()))
    # a filter of fixed size, whatever the streams
    places = staged.select("stream").distinct().select(F.explode(F.array(*_places(F.col("stream"), F.lit(bits)))).alias("p"))
    words = places.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("b")).collect()
    return {"batch": batch, "rows": facts.rows, "types": sorted(types) if len(types) <= MOST_TYPES else None, "bits": bits, "words": {str(r.w): r.b for r in words}}


def _stage(rows: DataFrame, root: str, n: int) -> str:
    """Write rows, whose ordinals are places in the segment, as a batch that could be segment n."""
    batch = f"{n}-{uuid.uuid4().hex}"
    out = rows.withColumn("ordinal", F.col("ordinal").bitwiseOR(F.lit(n << PLACE_BITS))).select(*COLUMNS)
    out.write.option("parquet.bloom.filter.enabled#stream", "true").option("parquet.bloom.filter.enabled#id", "true").parquet(_folder(root, batch))
    return batch


def _placed(rows: DataFrame, order: list) -> DataFrame:
    """rows in order over all partitions, with their places as ordinals."""
    at = F.monotonically_increasing_id()
    part, row = F.shiftright(at, 33), at.bitwiseAND((1 << 33) - 1)
    fits = (part < 1 << (PLACE_BITS - ROW_BITS)) & (row < 1 << ROW_BITS)
    place = F.when(fits, F.shiftleft(part, ROW_BITS).bitwiseOR(row)).otherwise(F.raise_error(F.lit("a batch of too many rows; append it in several")).cast("long"))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("ordinal", place).select(*COLUMNS)


def append(events: DataFrame, root: str, as_of: int | None = None, order: list | None = None, txn: tuple[str, int] | None = None, marks: dict[str, int] | None = None, whole: bool = False) -> int:
    """Commit events (rows of eventlog.SCHEMA) as the next segment, whole or not at all; its number, or the last one's where there are none.

    as_of: the last segment that the events were decided on. Where others have been committed since, and have events of
    one of the streams, this is a Conflict; others do no harm, and the batch goes behind them. whole: what was decided
    depends on all of the log (a new lead is one that no stream has), so that any segment since is a Conflict. order: columns that order
    the events (their ordinals, if none). txn: a writer's name and the number of its batch, which is committed once:
    a batch of that name with this number or a higher one makes this a repetition, of which nothing is written. marks:
    further names and numbers that done() tells from this segment on.
    """
    spark = events.sparkSession
    base = last(spark, root)
    if txn and done(spark, root, txn[0]) >= txn[1]:
        return base
    seen = base if as_of is None else as_of
    rows, n = _placed(events, order or ["ordinal"]), base + 1
    while True:
        batch = _stage(rows, root, n)
        staged = spark.read.schema(eventlog.SCHEMA).parquet(_folder(root, batch))
        said = _record(staged, batch)
        if said is None and txn is None:
            return base
        said = said or {"batch": batch, "rows": 0, "types": [], "bits": LEAST_BITS, "words": {}}
        while n - 1 > seen:  # what has come since
            if as_of is not None and whole:
                raise Conflict(f"the log has been written to since segment {as_of}")
            if as_of is not None and read(spark, root, seen + 1, n - 1).join(staged.select("stream").distinct(), "stream", "left_semi").limit(1).count():
                raise Conflict(f"streams have been written to since segment {as_of}")
            seen = n - 1
        apps = _apps(spark, root, n - 1)
        if txn and apps.get(txn[0], -1) >= txn[1]:
            return n - 1
        try:
            commits.create(spark, f"{root}/commits", n, {"n": n, **said, "apps": apps | ({txn[0]: txn[1]} if txn else {}) | (marks or {})})
            return n
        except Conflict:
            rows, n = staged.withColumn("ordinal", F.col("ordinal").bitwiseAND((1 << PLACE_BITS) - 1)), last(spark, root) + 1


def _apps(spark: SparkSession, root: str, n: int) -> dict[str, int]:
    """Each writer's last batch, as the record of segment n has it."""
    return (commits.record(spark, f"{root}/commits", n).get("apps") or {}) if n else {}


def done(spark: SparkSession, root: str, app: str) -> int:
    """The last number that is committed under this name; -1 if there is none."""
    return _apps(spark, root, last(spark, root)).get(app, -1)


def load_lines(spark: SparkSession, path: str, root: str, upcasts: eventlog.Upcasts | None = None, current: dict[str, int] | None = None, step: int = 1 << 38) -> int:
    """A log of lines as segments, each of at most so many bytes; the number of the last one."""
    end = eventlog.committed_end(path)
    for at in range(0, end, step):
        append(eventlog.read(spark, path, upcasts, current, since=at, until=min(end, at + step)), root)
    return last(spark, root)


def save_lines(rows: DataFrame, path: str) -> None:
    """Rows as a folder of text files, in order, each line an event as it stands in a log of lines."""
    lines = eventlog.encoded(rows.repartitionByRange("ordinal").sortWithinPartitions("ordinal"))
    lines.select(F.rtrim("line", F.lit("\n")).alias("value")).write.text(path)
