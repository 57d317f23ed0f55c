"""Ingestion as a stream: each micro-batch of postings is decided on the log as it is, and appended as one segment.

What a batch needs of the past (leads by identifier, their snapshots, marks and revisions) is the book, which is brought up to
the log's last segment and reads no more of it. A batch is committed under the stream's name and its number, so one that is
run again after a failure finds itself done; its ids come from these too. However postings are split into batches,
the log is that of one batch with all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import book, ingest, run, triage
from ..sources import segments
from ..sources.shared import keep


def decide_batch(postings: DataFrame, number: int, root: str, config: triage.Config, name: str, now: str) -> int:
    """Commit what one batch of postings (pos and a posting's fields, adapter, source) leads to; the log's last segment."""
    spark = postings.sparkSession
    if segments.done(spark, root, name) >= number:
        return segments.last(spark, root)
    postings = keep(postings)
    while True:
        at = segments.last(spark, root)
        known = book.Book(spark, root).update(at)
        state = book.aggregate_state(known.leads())
        # kept: gates, scores and events are made once, not again for each condition on them that Spark moves down
        results = keep(ingest.ingest(postings, state, book.index(known.forms()), config))
        events = run.events_of(results, state, f"{name}/{number}", now)
        try:
            return segments.append(events, root, at, ["ordinal"], (name, number), whole=True)
        except segments.Conflict:  # decided on what is no more: decide anew
            continue


def start(postings: DataFrame, root: str, config: triage.Config, checkpoint: str, name: str = "ingest", now: str | None = None, **trigger):
    """The query that ingests a stream of postings into the log of segments at root; trigger: as of DataStreamWriter."""

    def each(rows: DataFrame, number: int) -> None:
        at = now or rows.sparkSession.sql("select date_format(to_utc_timestamp(current_timestamp(), current_timezone()), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")").first()[0]
        decide_batch(rows.withColumn("pos", F.col("pos").cast("long")), number, root, config, name, at)

    return postings.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
