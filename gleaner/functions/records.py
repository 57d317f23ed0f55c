"""Structured postings out of JSON: JSON-LD in pages, the boards' own APIs, a paid feed's records.

All of it stays in the JVM (VARIANT and higher-order functions) but for HTML inside of JSON. A field counts only if
it has the expected JSON type; what has another type is null, and so is a record without a title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extraction import HOURS_A_YEAR, comp, html_text, remote, req_id
from .text import canonical_url, col, let, prettify_slug

# The script blocks that hold JSON-LD, and the words of a refusal for want of credits.
JSON_LD = r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""
REQUIRED_CREDITS = r"Required: (\d+) API credits"


def _kind(v: Column, path: str) -> Column:
    """JSON type of what lies at path: STRING, BIGINT, BOOLEAN, OBJECT<...>, ARRAY<...>; null if nothing does."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def str_at(v: Column, path: str) -> Column:
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def id_at(v: Column, path: str) -> Column:
    """A string, or a whole number as one."""
    return F.when(_kind(v, path).isin("STRING", "BIGINT"), F.try_variant_get(v, path, "string"))


def bool_at(v: Column, path: str) -> Column:
    return F.when(_kind(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def whole_at(v: Column, path: str) -> Column:
    """A number, rounded half away from zero, below zero as zero; text that looks like one isn't one."""
    return F.when(_kind(v, path).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.greatest(F.round(F.try_variant_get(v, path, "double")), F.lit(0.0)).cast("long"))


def items_at(v: Column, path: str) -> Column:
    """array<variant> at path; null if there is no array."""
    return F.when(_kind(v, path).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def _candidates(v: Column) -> Column:
    return F.coalesce(items_at(v, "$"), items_at(v, "$['@graph']"), F.when(_kind(v, "$").startswith("OBJECT"), F.array(v)), F.array().cast("array<variant>"))


def _is_posting(v: Column) -> Column:
    named = F.lower(str_at(v, "$['@type']")) == "jobposting"
    listed = F.exists(items_at(v, "$['@type']"), lambda t: F.coalesce(F.lower(str_at(t, "$")) == "jobposting", F.lit(False)))
    return F.coalesce(named, listed, F.lit(False))


def _place(v: Column) -> Column:
    parts = F.concat_ws(", ", *(str_at(v, f"$.jobLocation.address.{p}") for p in ("addressLocality", "addressRegion", "addressCountry")))
    return F.coalesce(str_at(v, "$.jobLocation"), str_at(v, "$.jobLocation.address"), F.when(parts != "", parts))


def _salary(v: Column) -> Column:
    hourly = F.coalesce(F.upper(str_at(v, "$.baseSalary.value.unitText")) == "HOUR", F.lit(False))
    low, high = (whole_at(v, f"$.baseSalary.value.{k}") * F.when(hourly, HOURS_A_YEAR).otherwise(1) for k in ("minValue", "maxValue"))
    raw = F.concat_ws(" - ", F.concat(F.lit("$"), low.cast("string")), F.concat(F.lit("$"), high.cast("string")))
    made = F.struct(low.alias("min"), high.alias("max"), F.coalesce(str_at(v, "$.baseSalary.currency"), F.lit("USD")).alias("currency"), F.when(hourly, "hour").otherwise("year").alias("period"), raw.alias("raw"))
    return F.when(low.isNotNull() | high.isNotNull(), made)


def _first(items: Column, make) -> Column:
    """make(first item), computed once; null if there is none."""
    return F.get(F.transform(F.slice(items, 1, 1), make), F.lit(0))


def json_ld(html) -> Column:
    """The first titled JobPosting among a page's JSON-LD blocks; blocks that can't be read are skipped."""
    blocks = F.regexp_extract_all(col(html), F.lit(JSON_LD), F.lit(1))
    nodes = F.flatten(F.transform(blocks, lambda b: _candidates(F.try_parse_json(b))))
    kind = lambda v: F.upper(str_at(v, "$.jobLocationType"))
    return _first(
        F.filter(nodes, lambda v: _is_posting(v) & str_at(v, "$.title").isNotNull()),
        lambda v: F.struct(
            str_at(v, "$.title").alias("title"), str_at(v, "$.hiringOrganization.name").alias("company"), str_at(v, "$.identifier.value").alias("req_id"), _place(v).alias("location"),
            F.when(kind(v) == "TELECOMMUTE", True).when(kind(v).isin("ONSITE", "ON_SITE", "HYBRID"), False).alias("remote"), _salary(v).alias("comp"), F.coalesce(str_at(v, "$.description"), F.lit("")).alias("body"),
        ),
    )


def _api(title, company, req, location, remote_, body) -> Column:
    return F.struct(title.alias("title"), company.alias("company"), req.alias("req_id"), location.alias("location"), remote_.cast("boolean").alias("remote"), F.coalesce(body, F.lit("")).alias("body"))


def greenhouse(json, board) -> Column:

    def made(v):
        title = str_at(v, "$.title")
        return F.when(title.isNotNull(), _api(title, prettify_slug(board), id_at(v, "$.id"), str_at(v, "$.location.name"), F.lit(None), str_at(v, "$.content")))

    return let(F.try_parse_json(col(json)), made)


def ashby(json, board, job_id) -> Column:
    """The board's job with this id; its tier summary is added to the text."""
    found = F.filter(items_at(F.try_parse_json(col(json)), "$.jobs"), lambda j: F.coalesce(id_at(j, "$.id") == col(job_id), F.lit(False)))

    def made(j):
        place = F.lower(str_at(j, "$.workplaceType"))
        flag = F.when(bool_at(j, "$.isRemote") | (place == "remote"), True).when(place.isin("hybrid", "onsite"), False)
        body = F.concat(F.coalesce(str_at(j, "$.descriptionHtml"), F.lit("")), F.coalesce(F.concat(F.lit("\nCompensation: "), str_at(j, "$.compensation.compensationTierSummary")), F.lit("")))
        return _api(str_at(j, "$.title"), prettify_slug(board), id_at(j, "$.id"), F.coalesce(str_at(j, "$.location"), str_at(j, "$.locationName")), flag, body)

    job = _first(found, made)
    return F.when(job["title"].isNotNull(), job)


def lever(json, board) -> Column:
    """Plain text is preferred: lists and the closing part follow on lines of their own; else the HTML parts as they are."""
    v = F.try_parse_json(col(json))
    lists = F.array_compact(F.transform(F.coalesce(items_at(v, "$.lists"), F.array().cast("array<variant>")), lambda x: str_at(x, "$.content")))
    plain, more, html_more = str_at(v, "$.descriptionPlain"), str_at(v, "$.additionalPlain"), str_at(v, "$.additional")
    # HTML of all parts goes through one call: the parts are parted by paragraphs of their own
    in_html = F.concat_ws("", F.transform(F.when(more.isNull() & html_more.isNotNull(), F.array_append(lists, html_more)).otherwise(lists), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))))
    told = F.concat_ws("\n", plain, F.when(in_html != "", html_text(in_html)), more)
    raw = F.concat(F.coalesce(str_at(v, "$.description"), F.lit("")), F.concat_ws("", lists), F.coalesce(html_more, F.lit("")))
    title = str_at(v, "$.text")
    return F.when(title.isNotNull(), _api(title, prettify_slug(board), id_at(v, "$.id"), str_at(v, "$.categories.location"), F.lit(None), F.when(plain.isNotNull(), told).otherwise(raw)))


def workday(json, tenant) -> Column:
    """The company stands in one of two fields, else the tenant's name is taken."""
    v = F.try_parse_json(col(json))
    g = lambda p: str_at(v, "$.jobPostingInfo." + p)
    return F.when(_kind(v, "$.jobPostingInfo").isNotNull(), _api(g("title"), F.coalesce(g("company"), g("companyName"), prettify_slug(tenant)), g("jobReqId"), g("location"), F.lit(None), g("jobDescription")))


def finalize(df: DataFrame, api: str, out: str) -> DataFrame:
    """df with fields of a posting from an API struct column: HTML becomes text only where there is a tag; what the API states wins."""
    body = F.col(f"{api}.body")
    tagged = body.contains("<")
    df = df.withColumn("_raw", F.when(tagged, html_text(F.when(tagged, body))).otherwise(body))
    raw, place = F.col("_raw"), F.col(f"{api}.location")
    fields = F.struct(
        F.col(f"{api}.title").alias("title"), F.col(f"{api}.company").alias("company"), F.coalesce(F.col(f"{api}.req_id"), req_id(raw)).alias("req_id"), place.alias("location"),
        F.coalesce(F.col(f"{api}.remote"), remote(place, raw)).alias("remote"), comp(raw).alias("comp"), raw.alias("raw_text"),
    )
    return df.withColumn(out, fields).drop("_raw")


# -- a paid feed ----------------------------------------------------------------------------------


def paid_records(json) -> Column:
    """array<struct> of a response's records; null if it has no array of them."""

    def made(v):
        low, high = whole_at(v, "$.min_annual_salary_usd"), whole_at(v, "$.max_annual_salary_usd")
        pay = F.struct(low.alias("min"), high.alias("max"), F.lit("USD").alias("currency"), F.lit("year").alias("period"), F.coalesce(str_at(v, "$.salary_string"), F.lit("")).alias("raw"))
        link = F.coalesce(str_at(v, "$.final_url"), str_at(v, "$.url"))
        on, mixed = bool_at(v, "$.remote"), bool_at(v, "$.hybrid")
        return F.struct(
            str_at(v, "$.job_title").alias("title"), F.coalesce(str_at(v, "$.company"), str_at(v, "$.company_object.name")).alias("company"), str_at(v, "$.location").alias("location"),
            remote_flags(on, mixed).alias("remote"), F.when(low.isNotNull() | high.isNotNull(), pay).alias("comp"), F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/]"), canonical_url(link)).alias("url"),
            F.coalesce(str_at(v, "$.description"), F.lit("")).alias("raw_text"), str_at(v, "$.discovered_at").alias("discovered_at"),
        )

    return F.transform(items_at(F.try_parse_json(col(json)), "$.data"), made)


def free_links(json) -> Column:
    """array<string>: the urls of a free feed's jobs; entries without a usable one are skipped, no array is null."""
    links = F.transform(items_at(F.try_parse_json(col(json)), "$.jobs"), lambda v: str_at(v, "$.url"))
    return F.filter(links, lambda u: F.coalesce(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/]"), F.lit(False)))


def remote_flags(on, mixed) -> Column:
    """Stated remote wins; hybrid, or stated not remote, is false; else unknown."""
    return F.when(col(on), True).when(col(mixed) | ~col(on), False)


def truncated(json) -> Column:
    return F.coalesce(whole_at(F.try_parse_json(col(json)), "$.metadata.truncated_results"), F.lit(0))


def unreturned(json) -> Column:
    """Records that a refusal for credits says are left; 0 if it doesn't say."""
    said = F.regexp_extract(str_at(F.try_parse_json(col(json)), "$.error.description"), REQUIRED_CREDITS, 1)
    return F.coalesce(said.try_cast("long"), F.lit(0))


def comp_disagrees(a: Column, b: Column) -> Column:
    """Ranges differ in anything but their raw words; one that is missing differs from one that isn't."""
    same = F.lit(True)
    for k in ("min", "max", "currency", "period"):
        same = same & a[k].eqNullSafe(b[k])
    return F.when(a.isNull() & b.isNull(), False).when(a.isNull() | b.isNull(), True).otherwise(~same)


def mismatches(record: str) -> Column:
    """Of comp and remote, those in which a record's own text says something else."""
    r = lambda k: F.col(f"{record}.{k}")
    differs = let(comp(r("raw_text")), lambda c: comp_disagrees(c, r("comp")))
    return F.array_compact(F.array(F.when(differs, F.lit("comp")), F.when(~remote(r("location"), r("raw_text")).eqNullSafe(r("remote")), F.lit("remote"))))
