"""The book, the state of streams and the index of identifiers, kept up to date: a new range of the log is folded by itself
and merged, and nothing of the log before it is read again.

A run is the fold of a range: a row for each lead with what is latest (by ordinal), sums, and bounds, all of which
merge; and a row for each identifier. Only two rules look back: events before a lead's first snapshot don't count in
the book, so a run is folded knowing which leads have one; and a revision is that of the largest evaluation plus the
snapshots after it, so runs' counts are added in their order. A record (numbered, see sources/commits.py) lists the
runs and the segment that they reach to; when there are many they are merged into one.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import commits, segments
from . import views

#: So many runs are merged into one.
MOST_RUNS = 8


def _at(when: Column, *fields: Column) -> Column:
    """The ordinal with some fields, of the rows that count."""
    return F.when(when, F.struct(F.col("ordinal").alias("o"), *fields))


def fold(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """A run of rows that views.typed() gives. known: (lead_id) of leads that have a snapshot in the log before."""
    t, snap = F.col("type"), F.col("type").isin(views.SNAPSHOTS)
    first = events.where(snap).groupBy("lead_id").agg(F.min("ordinal").alias("_first"))
    if known is not None:
        first = first.join(known.select("lead_id").distinct().withColumn("_known", F.lit(-1).cast("long")), "lead_id", "full").select("lead_id", F.coalesce("_known", "_first").alias("_first"))
    after = Window.partitionBy("lead_id").orderBy("ordinal").rowsBetween(1, Window.unboundedFollowing)
    rows = events.join(first, "lead_id", "left").withColumn("_after", F.coalesce(F.sum(snap.cast("long")).over(after), F.lit(0)))
    counts = F.coalesce(F.col("ordinal") >= F.col("_first"), F.lit(False))
    outcome, judged, reviewed = t.isin(views.OUTCOMES), t.isin(views.EVALUATIONS), t == "reviewed"
    told = F.struct("occurred_at", F.col("ordinal").alias("o"), t.alias("type"), "note", "method")
    small = F.col("snapshot").dropFields("raw_text")
    return rows.groupBy("lead_id").agg(
        F.min(_at(counts & snap, F.col("recorded_at"))).alias("first"), F.max(_at(counts, F.col("recorded_at"))).alias("last"), F.count_if(counts).alias("n"),
        F.max(_at(counts & reviewed, F.col("mark"))).alias("mark"), F.max(_at(counts & t.isin("reviewed", "apply_queued"), (t == "apply_queued").alias("queued"))).alias("queued"), F.count_if(counts & reviewed & (F.col("mark") == "defer")).alias("deferrals"),
        F.max(_at(counts & judged, F.when(t == "scored", F.col("score")).alias("score"), F.when(t == "rejected", F.col("rejection")).alias("rejection"))).alias("judged"), F.max(F.when(counts & outcome, told)).alias("outcome"), F.max(_at(counts & snap, small.alias("snapshot"))).alias("record"),
        # of the stream, whatever the book counts
        F.max(_at(snap, F.col("snapshot"))).alias("snapshot"), F.max(_at(reviewed, F.col("mark"))).alias("any_mark"), F.max(_at(snap | (t == "scored"), F.when(t == "scored", F.col("composite")).alias("composite"))).alias("any_score"), F.max(_at(F.lit(True), F.col("seq"))).alias("seq"),
        F.count_if(snap).alias("snapshots"), F.max(F.when(t.isin("scored", "rejected"), F.col("revision") + F.col("_after"))).alias("high"),
    )


def merge(runs: DataFrame) -> DataFrame:
    """One run of rows of several, which have their number in `run`."""
    later = Window.partitionBy("lead_id").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    rows = runs.withColumn("high", F.col("high") + F.coalesce(F.sum("snapshots").over(later), F.lit(0)))
    sums, least = ("n", "deferrals", "snapshots"), ("first",)
    return rows.groupBy("lead_id").agg(*((F.sum if c in sums else F.min if c in least else F.max)(c).alias(c) for c in runs.columns if c not in ("lead_id", "run")))


def index_run(events: DataFrame) -> DataFrame:
    """(form, latest): each identifier's last lead, with the ordinal."""
    forms = events.where("forms is not null and lead_id is not null").select("ordinal", "lead_id", F.explode("forms").alias("form"))
    return forms.groupBy("form").agg(F.max(F.struct(F.col("ordinal").alias("o"), "lead_id")).alias("latest"))


def merge_index(runs: DataFrame) -> DataFrame:
    return runs.groupBy("form").agg(F.max("latest").alias("latest"))


# -- what runs say ---------------------------------------------------------------------------------------


def lead_record(run: DataFrame) -> DataFrame:
    """views.lead_record() of the same log."""
    fields = ("dedupe_key", "identifiers", "adapter", "source", "url", "extracted")
    return run.where("first is not null").select(
        "lead_id", *(F.col(f"record.snapshot.{f}").alias(f) for f in fields), F.col("mark.mark").alias("latest_mark"), F.col("deferrals").alias("deferral_count"), F.coalesce("queued.queued", F.lit(False)).alias("apply_queued"),
        F.col("judged.score").alias("latest_score"), F.col("judged.rejection").alias("latest_rejection"), F.when(F.col("outcome").isNotNull(), F.struct("outcome.type", "outcome.note", "outcome.method", "outcome.occurred_at")).alias("latest_outcome"),
        F.col("first.recorded_at").alias("first_seen"), F.col("last.recorded_at").alias("last_event"), F.col("n").alias("event_count"),
    )


def aggregate_state(run: DataFrame) -> DataFrame:
    """views.aggregate_state() of the same log."""
    return run.select("lead_id", F.col("snapshot").isNotNull().alias("exists"), F.col("snapshot.snapshot").alias("snapshot"), F.col("any_mark.mark").alias("latest_mark"), F.col("any_score.composite").alias("latest_score"), F.col("seq.seq").alias("seq"), F.greatest(F.col("snapshots"), F.col("high")).alias("revision"))


def index(run: DataFrame) -> DataFrame:
    """views.index_of() of the same log."""
    return run.select("form", F.col("latest.lead_id").alias("lead_id"))


# -- runs beside a log -----------------------------------------------------------------------------------


class Book:
    """The runs of a log of segments, in its folder `book`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.records = spark, root, f"{root}/book/records"
        n = commits.last(spark, self.records)
        said = commits.record(spark, self.records, n) if n else {"runs": [], "until": 0}
        self.n, self.runs, self.until = n, said["runs"], said["until"]

    def _read(self, what: str) -> DataFrame | None:
        each = [self.spark.read.parquet(f"{self.root}/book/{run}/{what}").withColumn("run", F.lit(i)) for i, run in enumerate(self.runs)]
        return functools.reduce(DataFrame.unionByName, each) if each else None

    def leads(self) -> DataFrame:
        """One merged run of leads."""
        rows = self._read("leads")
        return fold(views.typed(segments.read(self.spark, self.root, 1, 0))) if rows is None else merge(rows) if len(self.runs) > 1 else rows.drop("run")

    def forms(self) -> DataFrame:
        rows = self._read("forms")
        return index_run(views.typed(segments.read(self.spark, self.root, 1, 0))) if rows is None else merge_index(rows)

    def at(self, until: int | None = None) -> tuple[DataFrame, DataFrame]:
        """The merged runs of leads and of identifiers at this segment; what the book doesn't reach to is folded, nothing is written."""
        until = segments.last(self.spark, self.root) if until is None else until
        leads, forms = self._read("leads"), self._read("forms")
        events = views.typed(segments.read(self.spark, self.root, self.until + 1, until)).where("lead_id is not null")
        run = lambda df: df.withColumn("run", F.lit(len(self.runs)))
        if leads is None:
            return fold(events), index_run(events)
        return merge(leads.unionByName(run(fold(events, leads.where("first is not null"))))), merge_index(forms.unionByName(run(index_run(events))))

    def update(self, until: int | None = None) -> Book:
        """The book with what has been committed since, up to segment `until`; only that part of the log is read.

        Someone else's update in the meantime makes this one void: the book is then theirs, updated further if need be.
        """
        until = segments.last(self.spark, self.root) if until is None else until
        if until <= self.until:
            return self
        events = views.typed(segments.read(self.spark, self.root, self.until + 1, until)).where("lead_id is not null")
        rows, run = self._read("leads"), uuid.uuid4().hex
        fold(events, None if rows is None else rows.where("first is not null")).write.parquet(f"{self.root}/book/{run}/leads")
        index_run(events).write.parquet(f"{self.root}/book/{run}/forms")
        return self._commit([*self.runs, run], until).compact()

    def compact(self) -> Book:
        if len(self.runs) <= MOST_RUNS:
            return self
        run = uuid.uuid4().hex
        self.leads().write.parquet(f"{self.root}/book/{run}/leads")
        self.forms().write.parquet(f"{self.root}/book/{run}/forms")
        return self._commit([run], self.until)

    def _commit(self, runs: list[str], until: int) -> Book:
        try:
            commits.create(self.spark, self.records, self.n + 1, {"runs": runs, "until": until})
        except commits.Conflict:
            return Book(self.spark, self.root).update(until)
        return Book(self.spark, self.root)
