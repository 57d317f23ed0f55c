"""Read models: folds of the event log in closed form.

An events DataFrame has: ordinal (log order), lead_id, type, occurred_at, recorded_at, and the payload
columns that a view needs (mark, composite, gate, revision, method; for whole records also snapshot, score, rejection
and note). No order-dependent state is carried: latest-wins is max_by over the ordinal, which combines before the
shuffle. The book reads the log twice, first for each lead's first snapshot; both sides are dealt by lead.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of event types and marks.
SNAPSHOTS = ["ingested", "updated", "edited"]
TERMINAL = ["accepted", "rejected_by_employer", "withdrawn", "declined", "unresponsive", "archived"]
OUTCOMES = ["applied", "screened", "interviewed", "offered", *TERMINAL]
EVALUATIONS = [*SNAPSHOTS, "scored", "rejected"]


def _latest(value: Column, among: Column, order: Column) -> Column:
    """The value at the largest order among some rows; a null value there stays null."""
    return F.max_by(F.when(among, F.struct(value.alias("v"))), F.when(among, order))["v"]


_EXTRACTED = "struct<title:string,company:string,req_id:string,location:string,remote:boolean,comp:struct<min:bigint,max:bigint,currency:string,period:string,raw:string>>"
_FORMS = "struct<req:string,url:string,tc:string>"
_PAYLOAD = f"dedupe_key string, identifiers {_FORMS}, adapter string, source string, url string, raw_text string, extracted {_EXTRACTED}, mark string, note string, method string, composite bigint, breakdown string, gate string, reason string, revision bigint, discovered_at map<string,string>"


def typed(log: DataFrame) -> DataFrame:
    """Rows of the event log with the columns that views read. A payload of the wrong shape, or a snapshot without an adapter,
    a score without a number or a mark without a word, is an error, never a null."""
    t, p = F.col("type"), F.col("_p")
    rows = log.withColumn("_p", F.from_json("payload", _PAYLOAD, {"mode": "FAILFAST"}))
    snap = t.isin(SNAPSHOTS)
    lacks = (snap & p["adapter"].isNull()) | ((t == "scored") & p["composite"].isNull()) | ((t == "rejected") & p["gate"].isNull()) | ((t == "reviewed") & p["mark"].isNull())
    rows = rows.withColumn("_p", F.when(lacks, F.raise_error(F.concat(F.lit("payload of event "), "id", F.lit(" lacks a field"))).cast(rows.schema["_p"].dataType)).otherwise(p))
    only = lambda when, value: F.when(when, value)
    fields = F.struct("_p.dedupe_key", "_p.identifiers", "_p.adapter", F.coalesce("_p.source", F.lit("unknown")).alias("source"), "_p.url", "_p.raw_text", "_p.extracted")
    return rows.select(
        "ordinal", "seq", "type", "occurred_at", "recorded_at", F.when(F.col("stream").startswith("lead/"), F.expr("substring(stream, 6)")).alias("lead_id"),
        only(t == "reviewed", p["mark"]).alias("mark"), only(t == "scored", p["composite"]).alias("composite"), only(t == "rejected", p["gate"]).alias("gate"), only(t.isin(OUTCOMES), p["method"]).alias("method"), p["note"].alias("note"),
        only(t.isin("scored", "rejected"), p["revision"]).alias("revision"), only(snap, fields).alias("snapshot"), only(t == "scored", F.struct("_p.composite", "_p.revision", "_p.breakdown")).alias("score"),
        only(t == "rejected", F.struct("_p.gate", "_p.reason", "_p.revision")).alias("rejection"),
        # suppressed re-ingests carry identifiers too
        only(snap | (t == "reingest_suppressed"), F.array_distinct(F.array_compact(F.array("_p.identifiers.req", "_p.identifiers.url", "_p.identifiers.tc", "_p.dedupe_key")))).alias("forms"),
        only(t == "discovery", p["discovered_at"]).alias("discovered_at"),
    )


def index_of(events: DataFrame) -> DataFrame:
    """(form, lead_id) of a typed log."""
    return lead_index(events.where("forms is not null and lead_id is not null"))


def _from_first_snapshot(events: DataFrame) -> DataFrame:
    """Events of leads that have a snapshot, from the first one on."""
    first = events.where(F.col("type").isin(SNAPSHOTS)).groupBy("lead_id").agg(F.min("ordinal").alias("_first"))
    return events.join(first, "lead_id").where("ordinal >= _first")


def _folds(whole: bool) -> list[Column]:
    t, o = F.col("type"), F.col("ordinal")
    snap, outcome, judged = t.isin(SNAPSHOTS), t.isin(OUTCOMES), t.isin(EVALUATIONS)
    score, rejection = ("score", "rejection") if whole else ("composite", "gate")
    told = F.struct(t.alias("type"), *((F.col("note"),) if whole else ()), F.col("method"), *((F.col("occurred_at"),) if whole else ()))
    return [
        *([_latest(F.col("snapshot"), snap, o).alias("snapshot")] if whole else []),
        _latest(F.col("mark"), t == "reviewed", o).alias("latest_mark"),
        F.count_if((t == "reviewed") & (F.col("mark") == "defer")).alias("deferral_count"),
        F.coalesce(_latest(t == "apply_queued", t.isin("reviewed", "apply_queued"), o), F.lit(False)).alias("apply_queued"),
        _latest(F.when(t == "scored", F.col(score)), judged, o).alias("latest_score"),
        _latest(F.when(t == "rejected", F.col(rejection)), judged, o).alias("latest_rejection"),
        F.max_by(F.when(outcome, told), F.when(outcome, F.struct("occurred_at", "ordinal"))).alias("latest_outcome"),
        F.min_by(F.when(snap, F.col("recorded_at")), F.when(snap, o)).alias("first_seen"),
        F.max_by("recorded_at", "ordinal").alias("last_event"),
        F.count("*").alias("event_count"),
    ]


def lead_book(events: DataFrame) -> DataFrame:
    """One row for each lead that has a snapshot; events before its first snapshot don't count."""
    return _from_first_snapshot(events).groupBy("lead_id").agg(*_folds(False))


def lead_record(events: DataFrame) -> DataFrame:
    """The book with all that the latest snapshot holds: 16 fields by the names that JSON results have.

    latest_score and latest_rejection are whole payloads; latest_outcome has type, note, method and occurred_at.
    """
    rows = _from_first_snapshot(events).groupBy("lead_id").agg(*_folds(True))
    return rows.select("lead_id", *(F.col(f"snapshot.{f}").alias(f) for f in ("dedupe_key", "identifiers", "adapter", "source", "url", "extracted")), *(c for c in rows.columns if c not in ("lead_id", "snapshot")))


def raw_text(events: DataFrame, lead=None) -> DataFrame:
    """(lead_id, raw_text): the text of each lead's latest snapshot, or of one lead's. Losers of a partition go before the
    shuffle; other parts of a snapshot aren't read."""
    found = events.where(F.col("type").isin(SNAPSHOTS) & F.col("lead_id").isNotNull())
    if lead is not None:
        found = found.where(F.col("lead_id") == lead)
    texts = found.select("lead_id", "ordinal", F.struct(F.col("snapshot.raw_text").alias("v")).alias("t"))
    return texts.groupBy("lead_id").agg(F.max_by("t", "ordinal")["v"].alias("raw_text"))


def aggregate_state(events: DataFrame) -> DataFrame:
    """What decisions need of each stream: latest snapshot, mark and score, the revision counter, the last seq.

    All events count, also those before the first snapshot; a rejection doesn't clear the score here.
    """
    t, o = F.col("type"), F.col("ordinal")
    snap = t.isin(SNAPSHOTS)
    folded = events.groupBy("lead_id").agg(
        F.max(snap).alias("exists"), _latest(F.col("snapshot"), snap, o).alias("snapshot"), _latest(F.col("mark"), t == "reviewed", o).alias("latest_mark"),
        _latest(F.when(t == "scored", F.col("composite")), snap | (t == "scored"), o).alias("latest_score"), F.max_by("seq", "ordinal").alias("seq"),
    )
    return folded.join(eval_revision(events), "lead_id")


def mark_method() -> Column:
    return F.when(F.col("latest_mark") == "apply-automatically", "auto-assisted").when(F.col("latest_mark") == "apply-manual", "manual")


def lifecycle_status() -> Column:
    kind, mark = F.col("latest_outcome.type"), F.col("latest_mark")
    method = F.coalesce(F.col("latest_outcome.method"), mark_method())
    return (
        F.when(kind == "applied", F.coalesce(F.concat(F.lit("applied ("), method, F.lit(")")), F.lit("applied")))
        .when(kind.isNotNull(), kind)
        .when(mark == "apply-automatically", "applying (auto-assisted)")
        .when(mark == "apply-manual", "applying (manual)")
        .when(mark == "defer", "deferred")
        .when(mark == "ignore", "ignored")
        .when(F.col("latest_score").isNotNull(), "pending")
        .when(F.col("latest_rejection").isNotNull(), "rejected (gate)")
        .otherwise("ingested")
    )


def is_terminal() -> Column:
    return F.coalesce(F.col("latest_outcome.type").isin(TERMINAL), F.lit(False))


def is_buried() -> Column:
    return F.col("latest_mark").eqNullSafe("ignore")


def is_gate_rejected() -> Column:
    return F.col("latest_rejection").isNotNull() & F.col("latest_score").isNull()


def active(book: DataFrame) -> DataFrame:
    return book.where(~is_terminal() & ~is_buried() & ~is_gate_rejected())


def pending(book: DataFrame) -> DataFrame:
    mark = F.col("latest_mark")
    open_ = mark.isNull() | (mark == "defer") | ((mark == "apply-automatically") & ~F.col("apply_queued"))
    return book.where(F.col("latest_score").isNotNull() & F.col("latest_outcome").isNull() & open_)


def rescore_targets(book: DataFrame) -> DataFrame:
    return book.where(~is_terminal() & ~is_buried())


def ranked(book: DataFrame) -> DataFrame:
    """rank: by score (none counts as 0), then first seen (null last), then id, over all partitions.

    Rows are numbered within bands of one score, one time and, as a bulk load has one time, a range of 65,536 ids (of text
    ids: of one first letter pair). The rows before a band are those of the days before, of the day's seconds before, of
    the second's times before, and of the time's bands before: a window over the sizes of each. A second has a million
    times at most; no task holds all rows.
    """
    kind = dict(book.dtypes)["lead_id"]
    band = F.substring("lead_id", 1, 2) if kind == "string" else F.floor(F.col("lead_id") / 65_536)
    levels = [["_score", "_day"], ["_second"], ["_time"], ["_band"]]
    keys = [c for level in levels for c in level]
    banded = book.withColumns({"_score": -F.coalesce(F.col("latest_score"), F.lit(0)), "_day": F.to_date("first_seen"), "_second": F.date_trunc("second", "first_seen"), "_time": F.col("first_seen"), "_band": band})
    within = banded.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy("lead_id")))
    sizes, above = banded.groupBy(*keys).agg(F.count("*").alias("_n")), None
    for i, level in enumerate(levels):
        outer = [c for x in levels[:i] for c in x]
        w = Window.partitionBy(*outer).orderBy(*(F.asc_nulls_last(c) for c in level)).rowsBetween(Window.unboundedPreceding, -1)
        own = sizes.groupBy(*outer, *level).agg(F.sum("_n").alias("_n")) if i < len(levels) - 1 else sizes
        own = own.withColumn("_own", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
        above = own.withColumnRenamed("_own", "_before") if above is None else _beside(own, above, outer).withColumn("_before", F.col("_before") + F.col("_own")).drop("_own")
    return _beside(within, above, keys).withColumn("rank", F.col("_row") + F.col("_before")).drop(*keys, "_row", "_before")


def _beside(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what was found for their keys; a null key is a key like another."""
    other = found.withColumnsRenamed({c: f"_of{c}" for c in keys})
    joined = rows.join(other, functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in keys)))
    return joined.drop(*(f"_of{c}" for c in keys))


def eval_revision(events: DataFrame) -> DataFrame:
    """(lead_id, revision): snapshots add one, evaluations set the larger; in closed form over one window."""
    after = Window.partitionBy("lead_id").orderBy("ordinal").rowsBetween(1, Window.unboundedFollowing)
    snap = F.col("type").isin(SNAPSHOTS).cast("long")
    rows = events.withColumns({"_snap": snap, "_after": F.coalesce(F.sum(snap).over(after), F.lit(0))})
    return rows.groupBy("lead_id").agg(F.greatest(F.sum("_snap"), F.max(F.when(F.col("type").isin("scored", "rejected"), F.col("revision") + F.col("_after")))).alias("revision"))


def lead_index(rows: DataFrame) -> DataFrame:
    """(form, lead_id): the last lead in log order that carries each identifier. rows: ordinal, lead_id, forms."""
    return rows.select("ordinal", "lead_id", F.explode("forms").alias("form")).groupBy("form").agg(F.max_by("lead_id", "ordinal").alias("lead_id"))


def by_prefix(book: DataFrame, prefix: str) -> DataFrame:
    return book.where(F.col("lead_id").cast("string").startswith(prefix)).orderBy("first_seen", "lead_id")


class NoSuchLead(LookupError):
    pass


class AmbiguousLead(LookupError):
    pass


def select_lead(book: DataFrame, prefix: str, named: int = 20):
    """The one lead whose id begins with the prefix, as a row; none or several are errors (`named` ids are listed)."""
    found = by_prefix(book, prefix)
    rows = found.limit(2).collect()
    if not rows:
        raise NoSuchLead(f"no lead matches id prefix '{prefix}'")
    if len(rows) > 1:
        ids = [str(r.lead_id) for r in found.select("lead_id").limit(named).collect()]
        raise AmbiguousLead(f"id prefix '{prefix}' is ambiguous (matches {found.count()} leads: {', '.join(ids)})")
    return rows[0]


# -- rows as they are shown --------------------------------------------------------------------------


def queue_rows(book: DataFrame) -> DataFrame:
    """Ranked records as rows of the list: nine columns."""
    score = F.col("latest_score.composite")
    rows = ranked(book.withColumns({"_record": F.struct("*"), "latest_score": score}))
    r = lambda f: F.col(f"_record.{f}")
    status = rows.withColumn("status", lifecycle_status())
    return status.select(F.col("rank").cast("long").alias("rank"), F.col("latest_score").alias("composite"), "lead_id", r("extracted.title").alias("title"), r("extracted.company").alias("company"), "deferral_count", F.col("latest_mark").alias("mark"), r("latest_outcome.type").alias("outcome"), "status")


def as_json(rows: DataFrame) -> DataFrame:
    """(value): each row as JSON; fields without a value are left out."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))
