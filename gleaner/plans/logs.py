"""Registered queries of the log as segments, of what follows it, and of ingestion in batches; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import book, views
from ..sources import segments
from ..sources.shared import shared_dir
from ..streaming import ingest as ingest_stream
from .cores import RESOLVED_SQL, _batch
from .inputs import BOOK_SQL, EVENTS_SQL, POSTINGS_SQL, log
from .queries import _GATES, _IDENTITY, CONFIG, query

#: The log is appended in so many segments.
APPENDS = 3


def _events(spark, d):
    """Rows of the log with whole payloads as JSON."""
    s, f = (lambda c: F.col(f"snapshot.{c}").alias(c)), F.col
    score, rejection = (F.struct(*(F.col(f"{n}.{c}").alias(c) for c in fields)) for n, fields in (("score", ("composite", "revision", "breakdown")), ("rejection", ("gate", "reason", "revision"))))
    payload = (
        F.when(f("snapshot").isNotNull(), F.to_json(F.struct(*(s(c) for c in ("dedupe_key", "identifiers", "adapter", "source", "url", "raw_text", "extracted"))))).when(f("type") == "scored", F.to_json(score))
        .when(f("type") == "rejected", F.to_json(rejection)).otherwise(F.to_json(F.struct("mark", "method", "note")))
    )
    at = "ordinal", F.lit(1).alias("envelope_version"), F.concat(F.lit("e"), f("ordinal").cast("string")).alias("id"), F.concat(F.lit("lead/"), f("lead_id").cast("string")).alias("stream"), f("ordinal").alias("seq"), "type", F.lit(1).alias("schema_version")
    return log(spark, d).select(*at, "occurred_at", "recorded_at", F.lit(None).cast("string").alias("causation_id"), F.lit("c").alias("correlation_id"), payload.alias("payload"))


def _appended(spark, d, follow: bool = False) -> str:
    """The root of a log that all events were appended to in order, part by part; with a book that follows each."""
    root, events = shared_dir(spark), _events(spark, d)
    low, high = events.agg(F.min("ordinal"), F.max("ordinal")).first()
    for i in range(APPENDS if low is not None else 0):
        a, b = (low + (high + 1 - low) * j // APPENDS for j in (i, i + 1))
        segments.append(events.where((F.col("ordinal") >= a) & (F.col("ordinal") < b)), root)
        if follow:
            book.Book(spark, root).update()
    return root


@query(f"WITH {EVENTS_SQL}, p AS (SELECT min(ordinal) AS low, max(ordinal) AS high FROM v) SELECT ordinal AS seq, 'lead/' || lead_id AS stream, type, mark, composite, gate, 1 + ((ordinal - low + 1) * {APPENDS} - 1) // (high + 1 - low) AS segment FROM v, p")
def segment_scan(spark, d):
    rows = segments.read(spark, _appended(spark, d))
    return views.typed(rows).select("seq", F.concat(F.lit("lead/"), "lead_id").alias("stream"), "type", "mark", "composite", "gate", F.shiftright("ordinal", segments.PLACE_BITS).alias("segment"))


@query(f"WITH {EVENTS_SQL}, l AS (SELECT lead_id FROM v WHERE type = 'scored' ORDER BY composite DESC, ordinal LIMIT 1) SELECT ordinal AS seq, type, composite, recorded_at FROM v JOIN l USING (lead_id)")
def stream_scan(spark, d):
    """All events of the lead with the highest score: only segments that may hold it are opened."""
    root = _appended(spark, d)
    top = views.typed(segments.read(spark, root, types=["scored"])).agg(F.min_by("lead_id", F.struct(-F.col("composite"), "ordinal")).alias("l")).first()["l"]
    rows = segments.read(spark, root, stream=f"lead/{top}")
    return views.typed(rows).select("seq", "type", "composite", "recorded_at")


@query(f"WITH {EVENTS_SQL} SELECT ordinal AS seq, lead_id, mark FROM v WHERE type IN ('reviewed', 'apply_queued')")
def type_scan(spark, d):
    rows = segments.read(spark, _appended(spark, d), types=["reviewed", "apply_queued"])
    return views.typed(rows).select("seq", F.col("lead_id").cast("long").alias("lead_id"), "mark")


@query(f"WITH {BOOK_SQL} SELECT lead_id, latest_mark, deferral_count, apply_queued, latest_score, latest_rejection, outcome, first_seen, last_event, event_count FROM s")
def book_follows_log(spark, d):
    """The book, brought up to date after each append from that append's events alone."""
    run = book.Book(spark, _appended(spark, d, True)).leads()
    b = book.lead_record(run)
    return b.select(F.col("lead_id").cast("long").alias("lead_id"), "latest_mark", "deferral_count", "apply_queued", F.col("latest_score.composite").alias("latest_score"), F.col("latest_rejection.gate").alias("latest_rejection"), F.col("latest_outcome.type").alias("outcome"), "first_seen", "last_event", "event_count")


@query(f"""WITH {EVENTS_SQL}, a AS (SELECT *, coalesce(sum((type IN ('ingested', 'updated'))::INT) OVER (PARTITION BY lead_id ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS after_ FROM v)
SELECT lead_id, bool_or(type IN ('ingested', 'updated')) AS exists, 'text ' || max(ordinal) FILTER (type IN ('ingested', 'updated')) AS raw_text, arg_max_null(mark, ordinal) FILTER (type = 'reviewed') AS latest_mark,
arg_max_null(CASE WHEN type = 'scored' THEN composite END, ordinal) FILTER (type IN ('ingested', 'updated', 'scored')) AS latest_score, max(ordinal) AS seq, greatest(sum((type IN ('ingested', 'updated'))::INT), max(revision + after_))::BIGINT AS revision FROM a GROUP BY lead_id""")
def state_follows_log(spark, d):
    s = book.aggregate_state(book.Book(spark, _appended(spark, d, True)).leads())
    return s.select(F.col("lead_id").cast("long").alias("lead_id"), "exists", F.col("snapshot.raw_text").alias("raw_text"), "latest_mark", "latest_score", "seq", F.col("revision").cast("long").alias("revision"))


_HEX = "regexp_replace(md5('ingest/' || CASE WHEN first <= half THEN 0 ELSE 1 END || 'new-' || first), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')"


@query(f"""WITH RECURSIVE {POSTINGS_SQL}, {_IDENTITY}, known AS (SELECT '' AS form, '' AS lead FROM p WHERE false), {RESOLVED_SQL}, g AS (SELECT leads.lead, pos, len({_GATES}) AS failures, (SELECT (min(pos) + max(pos)) // 2 FROM p) AS half FROM p JOIN leads USING (pos)),
l AS (SELECT min(pos) AS first, any_value(half) AS half, count(*) AS snapshots, sum(CASE WHEN failures > 0 THEN failures ELSE 0 END)::BIGINT AS rejections, count(*) FILTER (failures = 0) AS scores FROM g GROUP BY lead)
SELECT {_HEX} AS lead_id, snapshots, rejections, scores, snapshots + rejections + scores AS seq, snapshots AS revision FROM l""")
def ingest_in_batches(spark, d):
    """Postings come in two batches; each is decided on the log that the one before left, as one batch with all would be."""
    root, batch = shared_dir(spark), _batch(spark, d)
    half = batch.agg(F.floor((F.min("pos") + F.max("pos")) / 2)).first()[0]
    for i, part in enumerate((F.col("pos") <= half, F.col("pos") > half)):
        ingest_stream.decide_batch(batch.where(part), i, root, CONFIG, "ingest", "2024-01-01T00:00:00Z")
    rows = views.typed(segments.read(spark, root))
    n = lambda *t: F.count_if(F.col("type").isin(*t))
    return rows.groupBy("lead_id").agg(n(*views.SNAPSHOTS).alias("snapshots"), n("rejected").alias("rejections"), n("scored").alias("scores"), F.max("seq").alias("seq"), F.max("revision").alias("revision"))
