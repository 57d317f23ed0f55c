"""Write-side commands besides ingestion: edits, re-evaluation, outcomes, application packages, and what is shown.

Commands over tables are projections. A command that can't be carried out is data: `error` says why and `events`
is empty, so that one bad row ends no job. Patches and options, which come from one user, are checked by the driver.
"""

from __future__ import annotations

from pathlib import PurePath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import str_at
from ..functions.text import col, let, sanitize
from .decide import _PENDING, _event
from .triage import changed

# Outcome types, marks, and the fields that an edit may clear.
OUTCOMES = ["applied", "screened", "interviewed", "offered", "accepted", "rejected_by_employer", "withdrawn", "declined", "unresponsive", "archived"]
MARKS = ["apply-automatically", "apply-manual", "defer", "ignore"]
CLEARABLE = ["title", "company", "req_id", "location", "remote", "comp"]


def _none() -> Column:
    return F.array().cast(_PENDING)


def _judged(failures: Column, composite: Column, revision: Column) -> Column:
    """All rejections or one score, a revision further."""
    r = F.coalesce(revision, F.lit(0)).cast("bigint") + 1
    rejected = F.transform(failures, lambda f: _event("rejected", f["gate"], f["reason"], None, r)).cast(_PENDING)
    return F.when(F.size(failures) > 0, rejected).otherwise(F.array(_event("scored", None, None, composite.cast("bigint"), r)).cast(_PENDING))


def _unclear(failures: Column, composite: Column) -> Column:
    """An evaluation is either rejected or scored, never both, never neither."""
    return F.when((F.size(failures) > 0) & composite.isNotNull(), "evaluation is both rejected and scored").when((F.size(failures) == 0) & composite.isNull(), "evaluation is neither rejected nor scored")


def _done(error: Column, events: Column, **more: Column) -> Column:
    return F.struct(error.alias("error"), F.when(error.isNull(), events).otherwise(_none()).alias("events"), *(v.alias(k) for k, v in more.items()))


def decide_edit(old: str, new: str, failures: Column, composite: Column, exists: Column, revision: Column) -> Column:
    """struct(error, events, changed). old and new hold a posting's fields and source; old also the adapter.

    An edit makes the lead the user's, which alone is no change.
    """
    o, n = (lambda f: F.col(f"{old}.{f}")), (lambda f: F.col(f"{new}.{f}"))
    fields = F.filter(changed(old, new), lambda f: f != "raw_text")
    fields = F.array_compact(F.concat(fields, F.array(F.when(~o("source").eqNullSafe(n("source")), F.lit("source")))))
    error = F.when(~exists, "no such lead").otherwise(F.coalesce(_unclear(failures, composite), F.when(F.size(fields) == 0, "nothing to edit")))
    full = F.array_compact(F.concat(fields, F.array(F.when(~o("adapter").eqNullSafe(F.lit("user")), F.lit("adapter")))))
    return _done(error, F.concat(F.array(_event("edited")).cast(_PENDING), _judged(failures, composite, revision)), changed=full)


def decide_reevaluate(failures: Column, composite: Column, exists: Column, revision: Column) -> Column:
    """struct(error, events): an evaluation without a snapshot."""
    return _done(F.when(~exists, "no such lead").otherwise(_unclear(failures, composite)), _judged(failures, composite, revision))


def decide_package(exists: Column, mark: Column) -> Column:
    """struct(error, events): only an approved lead can be packaged (again)."""
    error = F.when(~exists, "no such lead").when(~mark.eqNullSafe("apply-automatically"), "not marked apply-automatically")
    return _done(error, F.array(_event("apply_queued")).cast(_PENDING))


def decide_outcome(kind: Column, exists: Column, mark: Column, method: Column, start_date: Column, reason: Column) -> Column:
    """struct(error, events, method): what happened to a lead; the method of an application is the mark's where none is given."""
    implied = F.when(mark == "apply-automatically", "auto-assisted").when(mark == "apply-manual", "manual")
    error = (
        F.when(~exists, "no such lead").when(~F.coalesce(kind.isin(OUTCOMES), F.lit(False)), "unknown outcome").when(method.isNotNull() & (kind != "applied"), "method is for applied only")
        .when(start_date.isNotNull() & (kind != "accepted"), "start date is for accepted only").when(reason.isNotNull() & (kind != "archived"), "reason is for archived only")
    )
    return _done(error, F.array(_event(kind)).cast(_PENDING), method=F.when(error.isNull() & (kind == "applied"), F.coalesce(method, implied)))


def rescore_summary(deltas: DataFrame) -> DataFrame:
    """One row of counts of what a re-evaluation did: delta is classify()'s word."""
    kinds = ["changed", "unchanged", "newly_rejected", "revived"]
    return deltas.agg(F.count("*").alias("evaluated"), *(F.count_if(F.col("delta") == k).alias(k) for k in kinds))


def pass_marker_faults(events: DataFrame, by: list[str]) -> DataFrame:
    """Evaluations (by lead and revision) that are both rejected and scored, or scored twice."""
    n = lambda t: F.count_if(F.col("type") == t)
    return events.where(F.col("type").isin("rejected", "scored")).groupBy(*by).agg(n("rejected").alias("rejections"), n("scored").alias("scores")).where("scores > 1 or scores = 1 and rejections > 0")


def check_patch(values: dict, clear: set[str]) -> None:
    """A field is set or cleared, not both; setting remote to unknown is a clear of its own."""
    unknown = (set(values) | clear) - set(CLEARABLE) - {"source", "url"}
    if unknown:
        raise ValueError(f"no such field: {', '.join(sorted(unknown))}")
    if kept := clear - set(CLEARABLE):
        raise ValueError(f"can't be cleared: {', '.join(sorted(kept))}")
    both = {f for f in clear & set(values) if not (f == "remote" and values[f] is None)}
    if both:
        raise ValueError(f"both set and cleared: {', '.join(sorted(both))}")


def patched(df: DataFrame, values: dict, clear: set[str] = frozenset()) -> DataFrame:
    """df with fields set or cleared. comp is a dict of min, max, currency, period or raw: the parts that it lacks stay."""
    check_patch(values, set(clear))
    out = {f: F.lit(v) for f, v in values.items() if f not in ("comp", "remote")} | {f: F.lit(None).cast(df.schema[f].dataType) for f in clear}
    if "remote" in values:
        out["remote"] = F.lit(values["remote"]).cast("boolean")
    if "comp" in values:
        kinds = df.schema["comp"].dataType
        out["comp"] = F.struct(*((F.lit(values["comp"][k.name]).cast(k.dataType) if k.name in values["comp"] else F.col("comp")[k.name]).alias(k.name) for k in kinds))
    return df.withColumns(out)


def cheat_sheet(resume) -> Column:
    """array<struct<question, answer>> from a résumé's JSON; questions without an answer are left out."""
    v = F.try_parse_json(col(resume))
    place = F.concat_ws(", ", *(str_at(v, f"$.basics.location.{k}") for k in ("city", "region", "countryCode")))
    # The questions.
    known = {"Full name": "$.basics.name", "Email address": "$.basics.email", "Phone number": "$.basics.phone"}
    last = {"Current or most recent title": "$.work[0].position", "Current or most recent employer": "$.work[0].name"}
    answers = [(q, str_at(v, p)) for q, p in known.items()] + [("Location", F.when(place != "", place))] + [(q, str_at(v, p)) for q, p in last.items()]
    return F.filter(F.array(*(F.struct(F.lit(q).alias("question"), a.alias("answer")) for q, a in answers)), lambda x: x["answer"].isNotNull())


def packages(book: DataFrame, resume: str | None = None, cover_letter: str | None = None, resume_path: str | None = None) -> DataFrame:
    """(lead_id, error, events, payload, value) of packaging each lead of a book (lead_id, latest_mark, url): the guard, the
    cheat sheet from a résumé's JSON (none: an empty one) and paths come to one result.

    payload: what the event apply_queued holds, without fields that are null. value: the command's JSON result, where a url
    that isn't there is null. Both are null where the guard says no. The résumé to send is the PDF beside `resume_path`.
    """
    pdf = None if resume_path is None else str(PurePath(resume_path).with_suffix(".pdf"))
    text = lambda v: F.lit(v).cast("string")
    package = F.struct(text(cover_letter).alias("cover_letter_path"), text(pdf).alias("resume_path"), F.coalesce(cheat_sheet(text(resume)), F.array().cast("array<struct<question:string,answer:string>>")).alias("cheat_sheet"))
    decided = book.select("lead_id", "url", decide_package(F.lit(True), F.col("latest_mark")).alias("d"), package.alias("package"))
    lead = F.col("lead_id").cast("string").alias("lead_id")
    value = F.when(F.col("url").isNotNull(), F.to_json(F.struct(lead, "package", "url"))).otherwise(F.regexp_replace(F.to_json(F.struct(lead, "package")), r"\}$", ',"url":null}'))
    done = lambda c: F.when(F.col("d.error").isNull(), c)
    return decided.select("lead_id", "d.error", "d.events", done(F.to_json(F.struct("package", "url"))).alias("payload"), done(value).alias("value"))


# -- what is shown -----------------------------------------------------------------------------------


def dump(events: DataFrame, lead: str | None = None, kind: str | None = None, stream: str = "stream") -> DataFrame:
    """(value): events as JSON lines in log order, of one lead or type if asked; `.write.text` takes it as it is."""
    if lead is not None:
        events = events.where(F.col(stream) == lead)
    if kind is not None:
        events = events.where(F.col("type") == kind)
    return events.orderBy("ordinal").select(F.to_json(F.struct(*(c for c in events.columns if c != "ordinal"))).alias("value"))


def lead_prefix(lead_id: Column) -> Column:
    return F.substring(lead_id.cast("string"), 1, 8)


def _named(title: Column, company: Column, between: str) -> Column:
    """Title and company; some titles end with the company already."""
    title, company = F.coalesce(sanitize(title), F.lit("Untitled")), F.coalesce(sanitize(company), F.lit(""))
    return let(F.struct(title.alias("t"), company.alias("c")), lambda x: F.when(F.lower(x["t"]).endswith(F.lower(x["c"])), x["t"]).otherwise(F.concat(x["t"], F.lit(between), x["c"])))


def list_line(rank: Column, lead_id: Column, title: Column, company: Column, composite: Column, status: Column, deferrals: Column | None = None) -> Column:
    """One line of a ranked list; control characters of postings never reach a terminal."""
    deferred = F.lit("") if deferrals is None else F.when(deferrals > 0, F.concat(F.lit("  (deferred "), deferrals.cast("string"), F.lit("×)"))).otherwise("")
    wide = lambda c: F.when(F.char_length(c) < 3, F.lpad(c, 3, " ")).otherwise(c)
    score = F.coalesce(wide(composite.cast("string")), F.lit("  -"))
    return F.concat(F.concat_ws("  ", wide(rank.cast("string")), score, lead_prefix(lead_id), _named(title, company, " @ ")), deferred, F.lit("  ["), sanitize(status), F.lit("]"))


def card(status: Column) -> Column:
    """A record (row of views.lead_record) as a card in Markdown: heading, score or rejection, a table, the url."""
    # The card's labels.
    f, clean = (lambda n: F.col(n)), sanitize
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    row = lambda name, v: F.when(v.isNotNull(), line(f"| {name} | ", v, " |\n"))
    remote = F.when(f("extracted.remote"), "Yes").when(~f("extracted.remote"), "No").otherwise("Unknown")
    judged = F.when(f("latest_score").isNotNull(), line("**Score: ", f("latest_score.composite").cast("string"), "**\n`", clean("latest_score.breakdown"), "`\n\n")).when(
        f("latest_rejection").isNotNull(), line("**Rejected: ", clean("latest_rejection.gate"), "**\n`", clean("latest_rejection.reason"), "`\n\n")
    )
    parts = [
        line("# ", _named(f("extracted.title"), f("extracted.company"), " - "), " - ", lead_prefix(f("lead_id")), "\n\n"), judged, F.lit("| Field | Value |\n|---|---|\n"),
        row("Location", clean("extracted.location")), row("Remote", remote), row("Compensation", clean(f("extracted.comp.raw"))),
        F.when(f("deferral_count") > 0, row("Deferral Count", f("deferral_count").cast("string"))), row("Status", clean(status)), row("Source", clean("source")), F.lit("\n"), line(clean("url"), "\n"),
    ]
    return F.concat_ws("", *parts)


def score_rgb(score: Column) -> Column:
    """struct(r, g, b) from red over yellow (50) to green (100)."""
    s = F.least(F.greatest(score.cast("double"), F.lit(0.0)), F.lit(100.0))
    part = lambda x: F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0))).cast("int")
    return F.struct(part((100 - s) * 255 / 50).alias("r"), part(s * 255 / 50).alias("g"), F.lit(0).alias("b"))
