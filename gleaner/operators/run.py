"""Runs: postings by url, and discovery from feeds into the log. The driver decides; rows stay in DataFrames.

Sources are objects with `charges` (whether a record costs) and fetch(spark, watermark, inbox) -> Batch. A source that
fails is data: its reason is in the run's summary and event, and other sources go on.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boards, records
from ..sources import commits, eventlog, segments
from ..sources.config import Settings, paid_query
from ..sources.fetch import Fetcher, pages
from . import book, decide, discovery, ingest, triage, views
from .resolve import _keep

_NAMES = ["title", "company", "req_id", "location", "remote", "comp", "raw_text", "url", "adapter"]
POSTING = "title string, company string, req_id string, location string, remote boolean, comp struct<min:bigint,max:bigint,currency:string,period:string,raw:string>, raw_text string, url string, adapter string"


def ingest_urls(urls: DataFrame, fetcher: Fetcher, pause: float | None = None) -> DataFrame:
    """(url, posting, error): boards are asked by their API first; what that doesn't give comes from the page, and a
    page that lies on a board after a redirect is asked for there. Transport failures never fall back."""
    ask = functools.partial(pages, fetcher=fetcher) if pause is None else functools.partial(pages, fetcher=fetcher, pause=pause)
    get = lambda df: _keep(ask(df.where("url is not null")))  # noqa: E731  a request is made once
    void = F.lit(None).cast("string")
    transport = F.when(F.col("kind") != "status", F.col("error"))

    def by_api(rows: DataFrame, at: str) -> DataFrame:
        """rows with api_body and fetch_error of the board that column `at` lies on."""
        rows = rows.withColumn("_api", boards.api_url(at))
        got = get(rows.select(F.col("_api").alias("url"))).select(F.col("url").alias("_api"), F.col("body").alias("api_body"), transport.alias("_failed"))
        return rows.join(got, "_api", "left").withColumn("fetch_error", F.coalesce("fetch_error", "_failed")).drop("_api", "_failed")

    todo = urls.select("url").where("url is not null").distinct()
    first = by_api(todo.select("url", F.col("url").alias("final_url"), void.alias("html"), void.alias("fetch_error")), "url")
    first = _keep(ingest.extract(first))
    done = first.where("posting is not null or fetch_error is not null")
    rest = first.where("posting is null and fetch_error is null").select("url")
    got = get(rest).select("url", F.coalesce("final_url", "url").alias("final_url"), F.col("body").alias("html"), F.when(F.col("body").isNull(), F.col("error")).alias("fetch_error"))
    moved = F.col("final_url") != F.col("url")
    second = by_api(got.withColumn("_to", F.when(moved, F.col("final_url"))), "_to").drop("_to")
    return done.select("url", "posting", "error").union(ingest.extract(second).select("url", "posting", "error"))


@dataclass
class Batch:
    """A source's postings (POSTING and pos), and what its fetch was like."""

    postings: DataFrame | None = None
    failed: int = 0
    truncated: int = 0
    credits: int = 0
    discovered_at: str | None = None
    error: str | None = None
    marks: dict[str, int] = field(default_factory=dict)


class Source(Protocol):
    charges: bool

    def fetch(self, spark: SparkSession, watermark: str | None, inbox: Inbox) -> Batch: ...


class Inbox:
    """Pages of a paid source that are paid for and in no run yet, beside the log.

    A page is put here, by number, as soon as it is answered; the segment that its records end up in says up to which
    number the inbox is done. So a run that fails, is dry, or loses its place to another has spent nothing in vain: the
    next one finds the pages, and goes on behind them where the source's cursor is still the same.
    """

    def __init__(self, spark: SparkSession, root: str, source: str):
        self.spark, self.folder, self.name, self.done = spark, f"{root}/inbox/{source}", f"inbox/{source}", segments.done(spark, root, f"inbox/{source}")

    def pages(self) -> list[dict]:
        return [commits.record(self.spark, self.folder, n) | {"n": n} for n in commits.numbers(self.spark, self.folder) if n > self.done]

    def put(self, page: dict) -> None:
        commits.create(self.spark, self.folder, commits.last(self.spark, self.folder) + 1, page)


class FreeFeed:
    """A feed of links: each posting is extracted from its own page. get() gives the feed's JSON."""

    charges = False

    def __init__(self, get: Callable[[], str], fetcher: Fetcher, pause: float | None = None):
        self.get, self.fetcher, self.pause = get, fetcher, pause

    def fetch(self, spark: SparkSession, watermark: str | None, inbox: Inbox) -> Batch:
        feed = spark.createDataFrame([(self.get(),)], "json string")
        links = _keep(feed.select(F.posexplode(records.free_links("json")).alias("pos", "url")))
        if feed.select(records.free_links("json").alias("l")).first().l is None:
            raise ValueError("the feed has no array of jobs")
        found = _keep(links.join(ingest_urls(links, self.fetcher, self.pause), "url", "left"))
        return Batch(found.where("posting is not null").select(F.col("pos").cast("long"), "posting.*").drop("source"), failed=found.where("posting is null").count())


class PaidFeed:
    """A feed that is paid by the record. post(query) gives a page's JSON or raises; balance() the credits left, or None."""

    charges = True

    def __init__(self, settings: Settings, name: str, post: Callable[[dict], str], balance: Callable[[], int | None]):
        self.settings, self.name, self.post, self.balance = settings, name, post, balance
        paid_query(settings, name)  # the user's own keys are checked before anything is asked for

    def fetch(self, spark: SparkSession, watermark: str | None, inbox: Inbox) -> Batch:
        import json

        query = paid_query(self.settings, self.name, watermark)
        held = inbox.pages()
        # pages of this very query: what follows them is still to be asked for, unless the last one was short
        same = [p for p in held if p["query"] == query]
        start = sum(p["records"] for p in same)

        def page(offset: int, limit: int) -> tuple[list, int]:
            raw = self.post(query | {"offset": offset, "limit": limit})
            answer = json.loads(raw)
            if not isinstance(answer.get("data"), list):
                raise ValueError("the response has no array of data")
            inbox.put({"query": query, "records": len(answer["data"]), "short": len(answer["data"]) < limit, "page": raw})
            return answer["data"], int((answer.get("metadata") or {}).get("truncated_results") or 0)

        got = discovery.Fetched()
        if not (same and same[-1]["short"]):
            try:
                got = discovery.fetch_within_budget(page, self.balance, self.settings.sources[self.name].get("max_credits_per_run"), start)
            except Exception as e:
                if not held:
                    raise
                got.error = f"{type(e).__name__}: {e}"  # what is paid for is used
        held = inbox.pages()
        pages_ = [(i, p["page"]) for i, p in enumerate(held)]
        rows = spark.createDataFrame(pages_, "at long, json string").select("at", F.posexplode(records.paid_records("json")).alias("i", "r"))
        rows = _keep(rows.select((F.shiftleft("at", 20) + F.col("i")).alias("pos"), "r.*"))
        from ..functions.text import watermark as in_utc

        newest = rows.agg(discovery.newest(in_utc("discovered_at"))).first()[0]
        postings = rows.drop("discovered_at").withColumns({"req_id": F.lit(None).cast("string"), "adapter": F.lit(self.name)})
        return Batch(postings, 0, got.truncated, got.spent, newest, got.error, {inbox.name: held[-1]["n"]} if held else {})


# -- events of a run ------------------------------------------------------------------------------------


def _payload(event: Column) -> Column:
    """An event's payload from a result of ingest.ingest() and the event's own fields; empty fields are left out."""
    kept = [F.col(f) for f in ("adapter", "source", "url", "raw_text")]
    extracted = F.struct(*triage.FIELDS[:6]).alias("extracted")
    forms = F.struct("identity.req", "identity.url", "identity.tc").alias("identifiers")
    kind, e = event["type"], lambda f: event[f].alias(f)
    return (
        F.when(kind == "ingested", F.to_json(F.struct("dedupe_key", forms, *kept, extracted)))
        .when(kind == "updated", F.to_json(F.struct("dedupe_key", forms, "changed", *kept, extracted)))
        .when(kind == "reingest_suppressed", F.to_json(F.struct("dedupe_key", F.lit("ignore").alias("suppressed_by_mark"), forms)))
        .when(kind == "rejected", F.to_json(F.struct(e("gate"), e("reason"), e("revision"))))
        .when(kind == "scored", F.to_json(F.struct("composite", e("revision"), "dimensions", "breakdown")))
    )


def _uuid(c: Column) -> Column:
    return F.regexp_replace(F.md5(c), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def events_of(results: DataFrame, state: DataFrame, run_id: str, now: str) -> DataFrame:
    """Rows of the log that a run's results lead to: stamped, each caused by the one before in its posting's batch."""
    seen = state.select(F.col("lead_id").cast("string").alias("lead_id"), F.col("seq").alias("expected_seq"))
    each = results.join(seen.hint("merge"), "lead_id", "left").withColumn("expected_seq", F.coalesce("expected_seq", F.lit(0))).select("*", F.posexplode("events").alias("_i", "_e"))
    lead = F.when(F.col("lead_id").startswith("new-"), _uuid(F.concat(F.lit(run_id), "lead_id"))).otherwise(F.col("lead_id"))
    at = F.lit(now).cast("timestamp")
    rows = each.select(
        "pos", "_i", "expected_seq", F.lit(1).alias("envelope_version"), _uuid(F.concat_ws("/", F.lit(run_id), "pos", "_i")).alias("id"), F.concat(F.lit("lead/"), lead).alias("stream"), F.col("_e.type").alias("type"), F.lit(1).alias("schema_version"),
        at.alias("occurred_at"), at.alias("recorded_at"), F.lit(run_id).alias("correlation_id"), _payload(F.col("_e")).alias("payload"),
    )
    stamped = decide.stamp(rows, ["stream"], ["pos", "_i"])
    stamped = stamped.withColumn("causation_id", F.when(F.col("_i") > 0, F.col("causation_id")))
    return stamped.withColumn("ordinal", F.col("pos") * 100 + F.col("_i")).select(*(c.split()[0] for c in eventlog.SCHEMA.split(", ")))


def discover(spark: SparkSession, root: str, settings: Settings, sources: dict[str, Source], only: str | None = None, dry_run: bool = False, yes: bool = False, json: bool = False, ask: Callable[[list[str]], bool] | None = None, now: str | None = None):
    """One run over the enabled sources (or the one named): its summary as a row, or None if no source is enabled or someone said no.

    root: a log of segments (see sources/segments.py). Sources are asked once, and what they gave is kept; then the log is
    read, the batch decided, and committed as one segment. Where another writer was there first, the batch is decided anew
    on what it wrote; nothing is fetched again. Watermarks go into the run's event, so a run that fails or is dry moves none.
    Nothing is written to the log on a dry run.
    """
    names = settings.chosen(only)
    if unknown := [n for n in names if n not in sources]:
        raise ValueError(f"unknown source: {', '.join(unknown)} (known: {', '.join(sorted(sources))})")
    if not names:
        return None
    paid = [n for n in names if sources[n].charges]
    if discovery.spend_gate(dry_run, yes, json, ask is not None, paid) == "prompt" and not ask(paid):
        return None
    runs = views.typed(segments.read(spark, root, types=["discovery"]))
    prior = {r.source: r.watermark for r in discovery.prior_watermarks(runs.where("discovered_at is not null")).collect()}  # a row for each source

    fetches, found, marks = [], [], {}
    for at, name in enumerate(names):
        try:
            b = sources[name].fetch(spark, prior.get(name), Inbox(spark, root, name))
        except Exception as e:  # one source's failure is that source's
            b = Batch(error=f"{type(e).__name__}: {e}")
        fetches.append((at, name, b.failed, b.truncated, b.credits, b.discovered_at, b.error))
        marks |= b.marks
        if b.postings is not None:
            found.append(b.postings.select((F.lit(at << 40) + F.col("pos")).alias("pos"), *_NAMES, F.lit(name).alias("source")))
    facts = discovery.fetch_facts(spark.createDataFrame(fetches, "position long, source string, failed long, truncated long, credits long, discovered_at string, error string"))
    batch = _keep(functools.reduce(DataFrame.union, found) if found else spark.createDataFrame([], f"pos long, {POSTING}, source string"))
    run_id, now = str(uuid.uuid4()), now or spark.sql("select date_format(to_utc_timestamp(current_timestamp(), current_timezone()), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")").first()[0]
    while True:
        end = segments.last(spark, root)
        known = book.Book(spark, root)
        leads, forms = known.at(end) if dry_run else ((known := known.update(end)).leads(), known.forms())
        state = _keep(book.aggregate_state(leads))
        results = _keep(ingest.ingest(batch, state, book.index(forms), settings.triage))
        summary = _keep(discovery.batch_summary(results, facts, settings.triage.remote_only, settings.triage.floor, dry_run))
        if dry_run:
            return summary.first()
        at = F.lit(now).cast("timestamp")
        own = discovery.run_event(summary).select(
            F.lit(2**62).alias("ordinal"), F.lit(1).alias("envelope_version"), F.lit(run_id).alias("id"), F.lit(f"discovery/{run_id}").alias("stream"), F.lit(1).cast("long").alias("seq"), F.lit("discovery").alias("type"), F.lit(1).alias("schema_version"),
            at.alias("occurred_at"), at.alias("recorded_at"), F.lit(None).cast("string").alias("causation_id"), F.lit(run_id).alias("correlation_id"), "payload",
        )
        events = events_of(results, state, run_id, now).withColumn("seq", F.col("seq").cast("long"))
        try:
            segments.append(events.union(own), root, end, marks=marks, whole=True)
            return summary.first()
        except segments.Conflict:  # decided on what is no more
            continue
