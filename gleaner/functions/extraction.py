"""Fields out of a posting's text: compensation, requisition id, remote work, years; text out of HTML.

Matching and arithmetic stay in the JVM; Arrow functions serve HTML only (`html`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import html_text, main_text  # noqa: F401
from .text import col, let, prefix_bytes, strip, token_in

# Patterns, bounds and factors that results depend on.
NEGATED_REMOTE = r"(?iuU)\b(not|no|never|isn't|isnt|aren't|arent)\s+(?:a\s+|an\s+)?remote\b\w*|\bnon-remote\b|\bremote\s+is\s+not\b"
ONSITE = r"(?iuU)\bhybrid\b|\bon[- ]site\b|\bin[- ]office\b|\bmust be (located|based) in\b"
NEGATED_ONSITE = r"(?iuU)\b(not|no|never|without|instead of|rather than)\s+(?:a\s+|an\s+|any\s+)?(hybrid|on[- ]site|in[- ]office)\b\w*(\s+(requirement|policy|option))?"
AMOUNT = r"(\d{2,3}(?:,\d{3})+|\d+(?:\.\d+)?)\s*(k)?"
RANGE = r"(?iuU)(?:USD\s*)?\$\s*" + AMOUNT + r"\s*(?:-|–|—|\bto\b)\s*(?:USD\s*)?\$?\s*" + AMOUNT
SINGLE = r"(?iuU)(?:USD\s*)?\$\s*(\d{2,3}(?:,\d{3})+)\s*(k)?"
HOURLY = r"(?iuU)\b(per\s+hour|hourly|/hr|an\s+hour)\b"
YEARLY = r"(?iuU)\b(annually|yearly|per\s+year|/yr|a\s+year)\b"
REQ_ID = r"(?iuU)\b(?:req(?:uisition)?(?:\s*id)?|job\s*(?:id|number|requisition)|requisition\s*id)\s*[:#]?\s*([A-Z0-9][A-Z0-9-]{2,})\b"
YEARS = r"(?iuU)(\d{1,2})\s*(?:\+|\s*[-–—]\s*\d{1,2})?\s*(?:years|yrs)"
EXPERIENCE = r"(?iuU)\b(?:experience|exp)\b"
HOURS_A_YEAR = 2080
HEAD_CHARS = 4000
PERIOD_WINDOW, YEARS_WINDOW = 120, 40
HOUR_BOUNDS, YEAR_BOUNDS = (10, 2_000), (10_000, 9_999_999)
LEVELS = [(100, ["principal", "staff", "architect"]), (70, ["senior", "lead"]), (10, ["junior", "associate", "entry", "intern"])]


def remote(location, text) -> Column:
    """true, false or null (unknown): stated on-site work wins, once its negations are masked."""
    location, head = col(location), F.left(col(text), F.lit(HEAD_CHARS))
    onsite = F.regexp_replace(F.coalesce(location, F.lit("")), NEGATED_ONSITE, "").rlike(ONSITE) | F.coalesce(F.regexp_replace(head, NEGATED_ONSITE, "").rlike(ONSITE), F.lit(False))
    said = F.coalesce(F.lower(location).contains("remote"), F.lit(False)) | F.coalesce(F.regexp_replace(head, NEGATED_REMOTE, "").rlike(r"(?iuU)\bremote\b"), F.lit(False))
    return F.when(onsite, F.lit(False)).when(said, F.lit(True))


def _nearest(window: Column, words: str, low: Column, middle: Column) -> Column:
    """Bytes from the start of the nearest match of words to the middle; null without a match. The window begins at byte low."""
    parts, found = F.split(window, words, -1), F.regexp_extract_all(window, F.lit(words), F.lit(0))
    start = F.struct(low.alias("at"), F.lit(None).cast("long").alias("best"))

    def step(state, x):
        at = state["at"] + F.octet_length(x["0"])
        return let(at, lambda at: F.struct((at + F.octet_length(F.coalesce(x["1"], F.lit("")))).alias("at"), F.when(x["1"].isNotNull(), F.least(state["best"], F.abs(at - middle))).otherwise(state["best"]).alias("best")))

    return F.aggregate(F.arrays_zip(parts.alias("0"), found.alias("1")), start, step, lambda s: s["best"])


def period_near(text: Column, match: Column) -> Column:
    """`hour` if an hourly word is nearer to the match than any yearly one, within PERIOD_WINDOW bytes around it; else `year`."""

    def judged(before):
        start = F.octet_length(before).cast("long")
        middle = F.floor((start * 2 + F.octet_length(match)) / 2)
        raw = F.encode(before, "UTF-8")
        # a character that the window's start would cut is in it whole
        head = F.coalesce(*(F.try_validate_utf8(F.substring(raw, (F.greatest(start - PERIOD_WINDOW, F.lit(0)) - i + 1).cast("int"), (start + 4).cast("int")).cast("string")) for i in range(4)))
        tail = F.substring(text, F.char_length(before) + F.char_length(match) + 1, F.lit(PERIOD_WINDOW + 1))
        window = F.concat(head, match, prefix_bytes(tail, F.lit(PERIOD_WINDOW)))
        low = start - F.octet_length(head)
        nearest = let(F.struct(window.alias("w"), low.alias("low"), middle.alias("mid")), lambda x: F.struct(_nearest(x["w"], HOURLY, x["low"], x["mid"]).alias("h"), _nearest(x["w"], YEARLY, x["low"], x["mid"]).alias("y")))
        return let(nearest, lambda n: F.when(n["h"].isNotNull() & (n["y"].isNull() | (n["h"] < n["y"])), "hour").otherwise("year"))

    return F.when(text.rlike(HOURLY), let(F.left(text, F.position(match, text) - 1), judged)).otherwise("year")


def _amount(digits: Column, k: Column, period: Column) -> Column:
    value = F.regexp_replace(digits, ",", "").try_cast("double") * F.when(k != "", 1000).otherwise(1)
    return let(F.floor(value).cast("long"), lambda v: F.when(F.when(period == "hour", v.between(*HOUR_BOUNDS)).otherwise(v.between(*YEAR_BOUNDS)), v))


def comp(text) -> Column:
    """struct(min, max, currency, period, raw) in USD a year, or null: the first range, else the first single amount."""
    text = col(text)

    def found(pattern: str, both: bool):
        def made(m):
            group = lambda i: F.regexp_extract(m["raw"], pattern, i)
            ends = F.struct(_amount(group(1), group(2), m["period"]).alias("low"), (_amount(group(3), group(4), m["period"]) if both else F.lit(None).cast("long")).alias("high"))
            factor = F.when(m["period"] == "hour", HOURS_A_YEAR).otherwise(1)
            fine = lambda e: e["low"].isNotNull() & e["high"].isNotNull() if both else e["low"].isNotNull()
            return let(ends, lambda e: F.when(fine(e), F.struct((e["low"] * factor).alias("min"), (e["high"] * factor).alias("max"), F.lit("USD").alias("currency"), m["period"].alias("period"), strip(m["raw"]).alias("raw"))))

        return let(F.regexp_extract(text, pattern, 0), lambda raw: F.when(raw != "", let(F.struct(raw.alias("raw"), period_near(text, raw).alias("period")), made)))

    return F.when(text.contains("$"), F.coalesce(found(RANGE, True), found(SINGLE, False)))


def req_id(text) -> Column:
    found = F.regexp_extract(col(text), REQ_ID, 1)
    return F.when(found.rlike("[0-9]"), found)


def years(text) -> Column:
    """Most years among mentions with experience before the next mention (or near the last one); else the first mention."""
    text = col(text)
    # numbers in other digits than ASCII's are none
    numbers = F.transform(F.regexp_extract_all(text, F.lit(YEARS), F.lit(1)), lambda x: x.try_cast("int"))
    after = F.slice(F.split(text, YEARS, -1), F.lit(2), F.lit(1 << 30))

    def made(x):
        last = F.size(x["n"]) - 1
        near = F.zip_with(x["n"], F.transform(x["after"], lambda a, i: F.when(i == last, prefix_bytes(a, F.lit(YEARS_WINDOW))).otherwise(a)), lambda n, a: F.when(a.rlike(EXPERIENCE), n))
        return F.when(F.size(x["n"]) > 0, F.coalesce(F.array_max(near), F.get(F.array_compact(x["n"]), F.lit(0))))

    return let(F.struct(numbers.alias("n"), after.alias("after")), made).cast("long")


def level(title, text) -> Column:
    title, out = F.coalesce(col(title), F.lit("")), None
    for points, words in LEVELS:
        hit = F.lit(False)
        for w in words:
            hit = hit | token_in(w, title)
        out = F.when(hit, points) if out is None else out.when(hit, points)
    by_years = let(years(text), lambda y: F.when(y.isNotNull(), F.floor(F.least(y, F.lit(15)) * 100 / 15)).otherwise(50))
    return out.otherwise(by_years).cast("long")
