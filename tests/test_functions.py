import pytest
from pyspark.sql import functions as F

from gleaner.functions import boards, extraction, text
from gleaner.operators import triage


def value(spark, column, **cols):
    schema = ", ".join(f"{k} string" for k in cols)
    return spark.createDataFrame([tuple(cols.values())], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize("t, low, high, period", [
    ("pays $120,000 - $150,000 a year", 120000, 150000, "year"),
    ("$120k to $150k", 120000, 150000, "year"),
    ("USD $50 – $70 per hour", 104000, 145600, "hour"),
    ("$180k", None, None, None),
    ("base $130,000", 130000, None, "year"),
    ("founded $5 - $7", None, None, None),
    ("$120 - $150k", None, None, None),
    ("é" * 100 + " hourly " + "é" * 70 + " $50 - $70", None, None, None),
    ("", None, None, None),
    ("pays $120,000\u00a0-\u00a0$150,000\u00a0a\u00a0year", 120000, 150000, "year"),
    ("hourly staff, $50 - $70", 104000, 145600, "hour"),
    ("$50 - $70 yearly " + "x" * 40 + " hourly", None, None, None),
    ("hourly " + "é" * 53 + "abc $50 - $70", 104000, 145600, "hour"),  # begins 117 bytes before
    ("hourly " + "é" * 57 + " $50 - $70", None, None, None),  # cut by the window
    ("$50 - $70" + "é" * 54 + " per hour", 104000, 145600, "hour"),
    ("$50 - $70" + "é" * 60 + " per hour", None, None, None),
    ("$12 - $15, then $130,000 a year", 130000, None, "year"),
    ("$30 - $40 /hr", None, None, None), ("$30 - $40/hr", 62400, 83200, "hour"),
])
def test_comp(spark, t, low, high, period):
    c = value(spark, extraction.comp("t"), t=t)
    assert (c and (c["min"], c["max"], c["period"])) == (None if period is None else (low, high, period))


@pytest.mark.parametrize("location, t, expected", [
    (None, "fully remote", True), (None, "not remote", None), ("Berlin", "remote team", True), ("Remote", "x", True), ("Berlin", "x", None),
    (None, "hybrid, remote", False), (None, "not hybrid; remote", True), (None, "must be located in Oslo", False), ("Not remote", "x", True),
    (None, "not\u00a0hybrid; remote", True), (None, "not\u00a0remote", None), (None, "must be\u00a0located in", None), (None, "x" * 4100 + " remote", None), (None, "no on-site requirement", None), (None, None, None),
])
def test_remote(spark, location, t, expected):
    assert value(spark, extraction.remote("l", "t"), l=location, t=t) is expected


@pytest.mark.parametrize("t, expected", [
    ("5+ years of experience", 5), ("3 years old, 8 years experience", 8), ("3-5 yrs exp", 3), ("12 years in business", 12), ("none", None),
    ("7 years " + "x" * 60 + " experience", 7), ("2 years, then 4 years", 2),
    ("5\u00a0years of\u00a0experience", 5), ("2 years a, 7 years " + "é" * 19 + " experience", 2), ("2 years a, 7 years " + "é" * 14 + " experience", 7), ("2 years a, 7 years" + "é" * 19 + " exp", 2), ("2 years a, 7 years " + "x" * 34 + " exp", 7), ("٣ years, 4 years", 4),
])
def test_years(spark, t, expected):
    assert value(spark, extraction.years("t"), t=t) == expected


@pytest.mark.parametrize("t, expected", [("Req ID: R-123", "R-123"), ("requisition # ABC", None), ("Job Number 42-17", "42-17"), ("x", None), ("Req\u00a0ID:\u00a0R-12", "R-12")])
def test_req_id(spark, t, expected):
    assert value(spark, extraction.req_id("t"), t=t) == expected


@pytest.mark.parametrize("u, expected", [
    ("HTTPS://Ex.com:443/a/?b=2&a=1&utm_x=1&gclid=3#f", "https://ex.com/a?a=1&b=2"),
    ("http://ex.com", "http://ex.com/"), ("http://ex.com:8080//?", "http://ex.com:8080/"), ("http://ex.com/a?x=a=b", "http://ex.com/a?x=a%3Db"),
    ("http://u@ex.com/a/../b c?x=1", "http://u@ex.com/b%20c?x=1"), ("http://u:p@Ex.com:80/", "http://u:p@ex.com/"), ("http://ex.com/a/./b/%2E%2e/c/", "http://ex.com/a/c"), ("http://ex.com/../..", "http://ex.com/"),
    ("https://[2001:DB8::1]:443/x", "https://[2001:db8::1]/x"), ("https://[::1]:8443/x", "https://[::1]:8443/x"), ("http://ex.com/é<>\"`{}|", "http://ex.com/%C3%A9%3C%3E%22%60%7B%7D|"), (" http://ex.com/a\tb\n ", "http://ex.com/ab"),
    ("http:\\\\ex.com\\a\\b", "http://ex.com/a/b"), ("http://ex.com/a?x=%zz+b&é=1", "http://ex.com/a?x=%25zz+b&%C3%A9=1"), ("http://ex.com/%41%2f?q=%41", "http://ex.com/%41%2f?q=A"), (None, None),
])
def test_canonical_url(spark, u, expected):
    assert value(spark, text.canonical_url("u"), u=u) == expected


@pytest.mark.parametrize("f, s, expected", [
    (text.slugify, "  Acme & Söhne, Inc. ", "acme-söhne-inc"), (text.slugify, "--", ""), (text.slugify, "ΟΔΟΣ", "οδοσ"), (text.slugify, "Όμιλος", "όμιλος"), (text.normalize_text, "ΟΔΟΣ  Α", "οδος α"), (text.normalize_req, "ΟΔΟΣ 1", "οδος1"), (text.slugify, "İx", "i-x"),
    (text.normalize_req, " R 1\t2 ", "r12"), (text.normalize_text, " A  b\nC ", "a b c"), (text.prettify_slug, "acme-big_corp--x", "Acme Big Corp X"),
    (text.company_from_title, "Dev — Acme, Inc", "Acme"), (text.company_from_title, "Dev at A", None), (text.company_from_title, "Dev", None),
    (text.sanitize, "a\x1bb", "ab"), (text.watermark, "2024-01-02T03:04:05.9+02:00", "2024-01-02T01:04:05Z"), (text.watermark, "soon", "soon"),
    (boards.platform, "https://x.myworkdayjobs.com/a/job/b", "workday"), (boards.platform, "https://ex.com/", None),
    (boards.api_url, "https://x.myworkdayjobs.com/en-US/s/job/a/b", "https://x.myworkdayjobs.com/wday/cxs/x/s/job/a/b"), (boards.api_url, "https://jobs.lever.co/a", None),
])
def test_text(spark, f, s, expected):
    assert value(spark, f("s"), s=s) == expected


@pytest.mark.parametrize("w, expected", [(0.0625, "0.062"), (1.0, "1"), (0.0, "0"), (0.5, "0.5"), (1 / 3, "0.333")])
def test_weight_text(spark, w, expected):
    assert spark.range(1).select(text.weight_text(F.lit(w)).alias("v")).first().v == expected


@pytest.mark.parametrize("company, entry, expected", [("Acme Corp", "acme-corp", True), ("AcmeCorp", "Acme Corp", True), ("The Acme Corp", "corp acme", True), ("Acme", "acme corp", False), ("Acme", "", False)])
def test_company_matches(spark, company, entry, expected):
    assert value(spark, triage.company_matches(F.col("c"), F.lit(entry)), c=company) is expected


@pytest.mark.parametrize("t, expected", [("we hate TABS " + "é" * 30 + " end", "TABS " + "é" * 20), ("tabs", "tabs"), ("Tabs\nnext", "Tabs\nnext"), ("none", None)])
def test_red_line_snippet(spark, t, expected):
    c = triage.Config(remote_only=False, red_lines=("tabs",))
    df = spark.createDataFrame([(t, None, None, "x", None)], "raw_text string, location string, remote boolean, company string, comp struct<min:bigint,max:bigint>")
    reasons = [f.reason for f in df.select(triage.gate_failures(c).alias("f")).first().f]
    assert reasons == ([] if expected is None else [f"posting matches red line 'tabs': …{expected}…"])


def test_no_python_in_extraction(spark):
    df = spark.createDataFrame([("t",)], "t string").select(extraction.comp("t"), extraction.years("t"), extraction.remote("t", "t"), extraction.req_id("t"), text.canonical_url("t"))
    assert "EvalPython" not in df._jdf.queryExecution().executedPlan().toString()


def test_bad_time_raises(spark):
    with pytest.raises(Exception, match="not a time"):
        value(spark, text.occurred_at("s"), s="yesterday")
