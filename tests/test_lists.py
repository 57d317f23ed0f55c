"""Long lists against the gates that try each entry by itself."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import lists, triage

COMPANIES = ["Acme Inc", "acme", "A.C.M.E.", "Big Acme Holding", "Beta-Gamma", "betagamma", "Évil & Co", None, "", "--", "Ümlaut GmbH"]
ENTRIES = ["acme", "ACME holding", "gamma beta", "beta gamma", "evil co", "évil co", "", "!!", "nobody", "inc", "acme", "umlaut", "a c m e"]
LINES = ["tabs", "TABS and", "é", "ß", "İ", "K", "", "a.b", "tabs", "straße", "Σ", "x" * 50, "$5 (net)"]


@pytest.fixture(scope="module")
def rows():
    g = random.Random(3)
    bits = ["tabs", "TABS AND", "spaces", "É", "STRASSE", "Straße", "i", "K", "a.b", "axb", "σς", "\n", "x" * 60, "$5 (NET)", "😀"]
    texts = [" ".join(g.choices(bits, k=g.randrange(1, 14))) for _ in range(120)] + [None, "", "tabs" + "é" * 60, "tabs😀" * 30]
    return [(i, g.choice(COMPANIES), t, g.choice([True, False, None]), "Oslo") for i, t in enumerate(texts)]


def test_gates_of_lists_are_those_of_triage(spark, rows):
    df = spark.createDataFrame(rows, "pos long, company string, raw_text string, remote boolean, location string").withColumn("comp", F.lit(None).cast("struct<min:bigint,max:bigint>"))
    c = triage.Config(floor=5, remote_only=True, blacklist=tuple(ENTRIES), red_lines=tuple(LINES))
    entries = spark.createDataFrame(list(enumerate(ENTRIES)), "at long, entry string")
    want = {r.pos: r.f for r in df.select("pos", triage.gate_failures(c).alias("f")).collect()}
    got = {r.pos: r.failures for r in lists.gated(df, c, entries, LINES).collect()}
    assert got == want and {f.gate for fs in want.values() for f in fs} == {"remote-only", "blacklist", "ideological"}
    none = lists.gated(df, triage.Config(remote_only=False), entries.limit(0), []).collect()
    assert len(none) == len(rows) and not any(r.failures for r in none)


def test_ten_thousand_lines(spark):
    lines = [f"line {i} of many" for i in range(10_000)]
    df = spark.createDataFrame([(i, f"LINE {i * 97} OF MANY, then line {i} of many") for i in range(100)], "pos long, raw_text string")
    got = {r.pos: [f.reason for f in r.f] for r in df.select("pos", lists.red_lined("raw_text", lines).alias("f")).collect()}
    assert got[3] == ["posting matches red line 'line 3 of many': …line 3 of many…", "posting matches red line 'line 291 of many': …LINE 291 OF MANY, then line 3 of many…"]
    assert all(len(v) == (1 if i == 0 else 2) for i, v in got.items())


def test_lines_as_a_table_are_those_of_the_list(spark, rows):
    texts = [(r[0], r[2]) for r in rows] + [(0, "Tabs again, STRASSE"), (999, "y" * 20 + "tabs" + "z" * 2_200_000 + "the very END of it")]
    lines = [*LINES, "end of it", "zzzzzzzz", "very end of nothing", "TABS", "😀"]
    df = spark.createDataFrame(texts, "pos long, raw_text string")
    listed = df.select("pos", F.explode(lists.red_lined("raw_text", lines)).alias("f")).select("pos", "f.gate", "f.reason")
    table = lists.red_lined_by(df, spark.createDataFrame(list(enumerate(lines)), "at long, line string"), "pos", "raw_text").select("pos", "gate", "reason")
    want = sorted(map(tuple, listed.collect()))
    assert sorted(map(tuple, table.collect())) == want and len(want) > 200
    assert lists.red_lined_by(df, spark.createDataFrame([], "at long, line string"), "pos", "raw_text").count() == 0


def test_a_table_of_lines_beyond_what_a_worker_holds(spark, monkeypatch):
    from gleaner.plans.queries import QUERIES

    monkeypatch.setattr(lists, "LINE_BYTES", 1000)
    assert QUERIES["red_line_table"](spark, "/root/testdata/sf0.001").count() == 150


def test_a_hundred_thousand_entries(spark):
    entries = spark.range(100_000).selectExpr("id as at", "concat('company ', id, if(id % 2 = 0, ' inc', '')) as entry")
    companies = spark.createDataFrame([(c,) for c in ("Company 7", "company 8", "Company-8 Inc.", "Inc 12 company group", "company12inc", "company 100001")], "company string")
    found = lists.blacklisted(companies, entries)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert {(r.company, r.at) for r in found.collect()} == {("Company 7", 7), ("Company-8 Inc.", 8), ("Inc 12 company group", 12), ("company12inc", 12)}
