"""The ingest core: postings in order against a log, and what each leads to. Nothing is fetched or written here.

A posting sees what earlier ones of its batch did: resolve() gives its lead, and the posting before it on the same
lead, if any, is the snapshot that it is compared with and adds to the revision. Marks don't change in a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boards, extraction, records
from ..functions.text import canonical_url, company_from_title, url_host, url_path
from . import triage
from .commands import _judged, _unclear
from .decide import _event, classify, decide_ingest
from .resolve import resolve

_KEPT = [*triage.FIELDS, "adapter", "source"]


# -- a posting out of what was fetched ---------------------------------------------------------------


def _blank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"\p{IsWhite_Space}+", "") == "", F.lit(True))


def extract(pages: DataFrame) -> DataFrame:
    """pages with `posting` (adapter, source, url, and a posting's fields) or `error`.

    pages: url, final_url, api_body (what the board's API said, if one was asked), html, fetch_error (a transport
    failure, which never falls back). The API's answer comes first, then JSON-LD, then the main text.
    """
    where = F.coalesce("final_url", "url")
    kind, body, part = F.col("_kind"), F.col("api_body"), lambda i: F.get(F.col("_path"), F.lit(i))
    pages = pages.withColumns({"_kind": boards.platform(where), "_path": F.filter(F.split(url_path(where), "/"), lambda x: x != ""), "_tenant": F.substring_index(url_host(where), ".", 1)})
    api = (
        F.when(kind == "greenhouse", records.greenhouse(body, part(0))).when(kind == "ashby", records.ashby(body, part(0), F.try_element_at("_path", F.lit(-1)))).when(kind == "lever", records.lever(body, part(0)))
        .when(kind == "workday", records.workday(body, "_tenant"))
    )
    # a page is read only where what comes before it gave nothing
    rows = records.finalize(pages.withColumn("_api", F.when(body.isNotNull(), api)), "_api", "_a")
    rows = rows.withColumn("_page", F.when(F.col("fetch_error").isNull() & (F.col("_api").isNull() | _blank(F.col("_a.raw_text"))), F.col("html"))).withColumn("_ld", records.json_ld("_page"))
    rows = rows.withColumn("_b", extraction.html_text(F.when(F.col("_ld").isNotNull(), F.col("_ld.body"))))
    rows = rows.withColumn("_main", extraction.main_text(F.when(_blank(F.col("_b")), F.col("_page"))))

    def fields(adapter, title, company, req, location, remote, comp, raw, url):
        made = {"title": title, "company": company, "req_id": req, "location": location, "remote": remote, "comp": comp, "raw_text": raw, "url": url, "adapter": adapter, "source": F.lit("unknown")}
        return F.struct(*(v.alias(k) for k, v in made.items()))

    a, ld, text, m = (lambda n: F.col(f"_a.{n}")), (lambda n: F.col(f"_ld.{n}")), F.col("_b"), F.col("_main.text")
    by_api = fields(F.col("_kind"), a("title"), a("company"), a("req_id"), a("location"), a("remote"), a("comp"), a("raw_text"), where)
    drop_in, none = F.lit("drop-in"), F.lit(None).cast("string")
    by_ld = fields(
        drop_in, ld("title"), F.coalesce(ld("company"), company_from_title(ld("title"))), F.coalesce(ld("req_id"), extraction.req_id(text)), ld("location"),
        F.coalesce(ld("remote"), extraction.remote(ld("location"), text)), F.coalesce(ld("comp"), extraction.comp(text)), text, where,
    )
    title = F.col("_main.title")
    by_text = fields(drop_in, title, company_from_title(title), extraction.req_id(m), none, extraction.remote(none, m), extraction.comp(m), m, where)
    fetched = F.col("fetch_error").isNull()
    posting = F.when(fetched, F.when(F.col("_api").isNotNull() & ~_blank(a("raw_text")), by_api).when(F.col("_ld").isNotNull() & ~_blank(text), by_ld).when(~_blank(m), by_text))
    error = F.coalesce("fetch_error", F.when(F.col("posting").isNull(), F.concat(F.lit("no text could be extracted from "), F.col("url"))))
    return rows.withColumn("posting", posting).withColumn("error", error).drop("_api", "_kind", "_path", "_tenant", "_page", "_ld", "_main", "_a", "_b")


# -- the core ------------------------------------------------------------------------------------------


def evaluated(df: DataFrame, c: triage.Config) -> DataFrame:
    """df with failures, and with dimensions, composite and breakdown, which are null where a gate failed."""
    out = triage.with_score(df.withColumn("failures", triage.gate_failures(c)), c)
    passed = F.size("failures") == 0
    return out.withColumns({n: F.when(passed, F.col(n)) for n in ("dimensions", "composite", "breakdown")})


def ingest(postings: DataFrame, state: DataFrame, index: DataFrame, c: triage.Config) -> DataFrame:
    """One row for each posting, in order of pos: lead_id, kind, changed, rejected, composite, breakdown, revision, events and its fields.

    postings: pos and a posting's fields, adapter and source; state: rows of views.aggregate_state; index: (form, lead_id).
    """
    rows = postings.withColumn("url", canonical_url("url")).withColumn("identity", triage.identity())
    found = resolve(rows.select("pos", "identity"), index)
    rows = rows.join(found.hint("merge"), "pos")
    known = state.select(F.col("lead_id").cast("string").alias("lead_id"), F.col("latest_mark").alias("_mark"), F.col("revision").alias("_revision"), F.col("snapshot").alias("_stored"))
    rows = rows.join(known.hint("merge"), "lead_id", "left")  # both grow with the batch or the log
    w = Window.partitionBy("lead_id").orderBy("pos")
    before = F.lag(F.struct(*_KEPT)).over(w)
    stored = F.struct(*(F.col(f"_stored.extracted.{f}").alias(f) for f in triage.FIELDS[:6]), *(F.col(f"_stored.{f}").alias(f) for f in ("raw_text", "url", "adapter", "source")))
    rows = rows.withColumns({"_nth": F.row_number().over(w) - 1, "_old": F.coalesce(before, F.when(F.col("_stored").isNotNull(), stored)), "_new": F.struct(*_KEPT)})
    rows = evaluated(rows, c)
    exists, muted = F.col("_old").isNotNull(), F.col("_mark").eqNullSafe("ignore")
    changed = F.array_compact(F.concat(triage.changed("_old", "_new"), F.array(*(F.when(~F.col(f"_old.{f}").eqNullSafe(F.col(f)), F.lit(f)) for f in ("adapter", "source")))))
    revision = F.coalesce("_revision", F.lit(0)) + F.col("_nth")
    events = decide_ingest(exists, F.col("_mark"), revision, F.col("failures"), F.col("composite"))
    kind = F.when(muted, "reingest_suppressed").when(exists, "updated").otherwise("ingested")
    return rows.withColumns({
        "kind": kind, "changed": F.when(~muted & exists, changed), "rejected": F.when(~muted & (F.size("failures") > 0), F.col("failures")),
        "composite": F.when(~muted, F.col("composite")), "breakdown": F.when(~muted, F.col("breakdown")), "dimensions": F.when(~muted, F.col("dimensions")), "revision": F.when(~muted, revision + 1).cast("long"), "events": events, "dedupe_key": F.col("identity.dedupe_key"),
    }).drop("_mark", "_revision", "_stored", "_nth", "_old", "_new", "failures")


def snapshot_fields(state: DataFrame) -> DataFrame:
    """state with the fields of its latest snapshot as columns, as gates and scores read them."""
    return state.select("*", *(F.col(f"snapshot.extracted.{f}").alias(f) for f in triage.FIELDS[:6]), F.coalesce("snapshot.raw_text", F.lit("")).alias("raw_text"))


def rescore(records_: DataFrame, state: DataFrame, c: triage.Config) -> DataFrame:
    """Stored snapshots under the configuration of now: lead_id, title, old_composite, new_composite, delta, rejected_gates, events.

    records_: the targets (rows of views.lead_record). Leads don't interact, so this is a join and a projection.
    """
    r = records_.select("lead_id", F.col("latest_score.composite").alias("old_composite"), (F.col("latest_rejection").isNotNull() & F.col("latest_score").isNull()).alias("_was"))
    rows = evaluated(snapshot_fields(r.join(state.where("exists"), "lead_id")), c)
    failed = F.size("failures") > 0
    delta = classify(F.col("old_composite"), F.col("_was"), F.col("composite"), failed)
    return rows.select("lead_id", "title", "old_composite", F.col("composite").alias("new_composite"), delta.alias("delta"), F.transform("failures", lambda f: f["gate"]).alias("rejected_gates"), _judged(F.col("failures"), F.col("composite"), F.col("revision")).alias("events"))


def edit(corrected: DataFrame, state: DataFrame, index: DataFrame, c: triage.Config) -> DataFrame:
    """Corrections of leads: lead_id, error, changed, rejected, composite, events; identifiers that other leads own are refused.

    corrected: lead_id, title to comp, url and source as they are to be. The text is the lead's own.
    """
    known = state.select("lead_id", F.col("exists").alias("_exists"), F.col("revision").alias("_revision"), F.col("snapshot").alias("_stored"), F.coalesce("snapshot.raw_text", F.lit("")).alias("raw_text"))
    rows = corrected.join(known, "lead_id", "left").withColumn("identity", triage.identity())
    rows = evaluated(rows, c)
    owned = triage.collisions(rows, index).select("lead_id", F.struct("owner", "form").alias("_other"))
    rows = rows.join(owned, "lead_id", "left")
    old = F.struct(*(F.col(f"_stored.extracted.{f}").alias(f) for f in triage.FIELDS[:6]), *(F.col(f"_stored.{f}").alias(f) for f in ("raw_text", "url", "adapter", "source")))
    rows = rows.withColumns({"_old": old, "_new": F.struct(*triage.FIELDS, "source")})
    fields = F.filter(F.array_compact(F.concat(triage.changed("_old", "_new"), F.array(F.when(~F.col("_old.source").eqNullSafe(F.col("source")), F.lit("source"))))), lambda f: f != "raw_text")
    rows = rows.withColumn("_fields", fields)
    collides = F.concat(F.lit("edit would collide with lead "), F.col("_other.owner").cast("string"), F.lit(" on identity "), F.col("_other.form"))
    error = F.when(~F.coalesce("_exists", F.lit(False)), "no such lead").otherwise(F.coalesce(collides, _unclear(F.col("failures"), F.col("composite")), F.when(F.size("_fields") == 0, "nothing to edit")))
    full = F.array_compact(F.concat(F.col("_fields"), F.array(F.when(~F.col("_old.adapter").eqNullSafe(F.lit("user")), F.lit("adapter")))))
    made = F.concat(F.array(_event("edited")), _judged(F.col("failures"), F.col("composite"), F.col("_revision")))
    rows = rows.withColumn("error", error)
    fine = F.col("error").isNull()
    return rows.select("lead_id", "error", F.when(fine, full).alias("changed"), F.when(fine & (F.size("failures") > 0), F.col("failures")).alias("rejected"), F.when(fine, F.col("composite")).alias("composite"), F.when(fine, made).alias("events"))

