"""Write side: what events a posting, a mark or an outcome leads to, and how a batch is stamped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PENDING = "array<struct<type:string,gate:string,reason:string,composite:bigint,revision:bigint>>"


def _event(kind, gate=None, reason=None, composite=None, revision=None) -> Column:
    null = lambda c, t: F.lit(None).cast(t) if c is None else c
    return F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("type"), null(gate, "string").alias("gate"), null(reason, "string").alias("reason"), null(composite, "bigint").alias("composite"), null(revision, "bigint").alias("revision"))


def decide_ingest(exists: Column, mark: Column, revision: Column, failures: Column, composite: Column) -> Column:
    """array of events: suppressed for an ignored lead; else a snapshot, and all rejections or one score.

    revision: the lead's before this evaluation (0 for a new one), one further with it: the snapshot and what it is
    judged to be share a revision.
    """
    snapshot = F.when(exists, "updated").otherwise("ingested")
    r = F.coalesce(revision, F.lit(0)).cast("bigint") + F.lit(1)
    judged = F.when(F.size(failures) > 0, F.transform(failures, lambda f: _event("rejected", f["gate"], f["reason"], None, r)).cast(_PENDING)).otherwise(F.array(_event("scored", None, None, composite.cast("bigint"), r)).cast(_PENDING))
    return F.when(mark.eqNullSafe("ignore"), F.array(_event("reingest_suppressed")).cast(_PENDING)).otherwise(F.concat(F.array(_event(snapshot)).cast(_PENDING), judged))


def decide_mark(mark: Column, reviewable: Column) -> Column:
    """A reviewed event, and apply_queued after apply-automatically."""
    queued = F.when((mark == "apply-automatically") & reviewable, F.lit("apply_queued"))
    return F.array_compact(F.array(F.lit("reviewed"), queued))


def stamp(pending: DataFrame, by: list[str], order: list[str], expected: str = "expected_seq") -> DataFrame:
    """seq follows the stream's expected one; causation_id is the event before in the same batch."""
    w = Window.partitionBy(*by).orderBy(*order)
    return pending.withColumns({"seq": F.col(expected) + F.row_number().over(w), "causation_id": F.lag("id").over(w)})


def classify(before: Column, was_rejected: Column, after: Column, rejected: Column) -> Column:
    """What a new evaluation changes."""
    return F.when(was_rejected & rejected, "unchanged").when(rejected, "newly_rejected").when(was_rejected, "revived").when(before.eqNullSafe(after), "unchanged").otherwise("changed")
