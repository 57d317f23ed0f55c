import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from gleaner.functions import records
from gleaner.operators import commands, decide, ingest, views
from gleaner.sources import config, fetch


def value(spark, column, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(column.alias("v")).first().v


def ld(*items):
    return "".join(f"<SCRIPT type = 'application/ld+json'>{x if isinstance(x, str) else json.dumps(x)}</script>" for x in items)


@pytest.mark.parametrize("html, title", [
    (ld({"@type": "JobPosting", "title": "A"}), "A"), (ld("{", [{"@type": "Other", "title": "x"}, {"@type": "JobPosting", "title": "B"}]), "B"),
    (ld({"@graph": [{"@type": ["X", "JOBPOSTING"], "title": "C"}]}), "C"), (ld({"@type": "JobPosting"}, {"@type": "JobPosting", "title": "D"}), "D"),
    (ld({"@type": "JobPosting", "title": 5}), None), (ld(5, "null"), None), ("<p>", None), ("", None), (None, None),
])
def test_json_ld(spark, html, title):
    found = value(spark, records.json_ld("h"), h=html)
    assert (found and found["title"]) == title


def test_boards(spark):
    assert value(spark, records.greenhouse("j", F.lit("b")), j='{"id": 5}') is None
    assert value(spark, records.ashby("j", F.lit("b"), F.lit("1")), j='{"jobs":[{"id":2,"title":"x"}]}') is None
    assert value(spark, records.ashby("j", F.lit("b"), F.lit("1")), j="{}") is None
    assert value(spark, records.lever("j", F.lit("b")), j='{"text":"T","description":"<p>a</p>","lists":[{"content":"<li>b</li>"},{}],"additional":"c"}')["body"] == "<p>a</p><li>b</li>c"
    assert value(spark, records.lever("j", F.lit("b")), j='{"text":"T","descriptionPlain":"a","lists":[{"content":"<li>b</li>"}],"additionalPlain":"c"}')["body"] == "a\nb\nc"
    assert value(spark, records.workday("j", F.lit("big-co")), j='{"jobPostingInfo":{"title":"T"}}')["company"] == "Big Co"
    assert value(spark, records.workday("j", F.lit("big-co")), j='{"jobPostingInfo":{"title":"T","companyName":"N"}}')["company"] == "N"


@pytest.mark.parametrize("flags, expected", [("true,true", True), ("false,true", False), ("false,null", False), ("null,true", False), ("null,false", None), ("null,null", None), ("true,null", True)])
def test_remote_flags(spark, flags, expected):
    on, mixed = (None if x == "null" else x == "true" for x in flags.split(","))
    assert spark.createDataFrame([(on, mixed)], "a boolean, b boolean").select(records.remote_flags("a", "b").alias("v")).first().v is expected


def test_refusal(spark):
    assert value(spark, records.unreturned("j"), j='{"error":{"description":"Required: 301 API credits"}}') == 301
    assert value(spark, records.unreturned("j"), j="no json") == 0


def test_patch(spark):
    df = spark.createDataFrame([("T", True, (1, 2, "x"))], "title string, remote boolean, comp struct<min:bigint,max:bigint,raw:string>")
    row = commands.patched(df, {"comp": {"max": 9}, "remote": None}, {"title"}).first()
    assert row.title is None and row.remote is None and tuple(row.comp) == (1, 9, "x")
    with pytest.raises(ValueError, match="both"):
        commands.check_patch({"title": "a"}, {"title"})
    with pytest.raises(ValueError, match="no such"):
        commands.check_patch({"colour": "a"}, set())


def test_dump(spark):
    df = spark.createDataFrame([(2, "s", "b"), (1, "s", "a"), (3, "t", "a")], "ordinal long, stream string, type string")
    assert [json.loads(r.value)["type"] for r in commands.dump(df, lead="s").collect()] == ["a", "b"]
    assert commands.dump(df, kind="a").count() == 2


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("KEY", "k1")
    (tmp_path / "cv.json").write_text('{"skills":[{"keywords":["Py","SQL"]},{"keywords":["py"]}]}')
    p = tmp_path / "config.toml"
    p.write_text(f'compensation_floor = 100\nremote_only = true\nblacklist = ["a.com", "Bad Co"]\nresume_path = "{tmp_path}/cv.json"\n[sources.paid]\nenabled = true\napi_key = "x${{KEY}}${{NONE_SUCH}}"\nstrict_filtering = true\n[sources.free]\nenabled = true\n[sources.off]\n')
    s = config.load(p)
    assert s.chosen() == ["free", "paid"] and s.chosen("off") == ["off"] and s.sources["paid"]["api_key"] == "xk1" and s.triage.skills == ("Py", "SQL")
    assert config.paid_query(s, "paid", "w") == {"posted_at_max_age_days": 30, "limit": 500, "company_domain_not": ["a.com"], "company_name_not": ["Bad Co"], "workplace_types_or": ["remote"], "min_salary_usd": 100, "discovered_at_gte": "w"}
    for bad in ("compensation_floor = 5\ncompensation_ceiling = 5", "colour = 1", "[scoring_weights]\nlevel = -1", "compensation_plausibility_multiplier = 0.5"):
        p.write_text(bad)
        with pytest.raises(ValueError):
            config.load(p)
    assert config.load(tmp_path / "none") == config.Settings()
    with pytest.raises(FileNotFoundError):
        config.load(tmp_path / "none", required=True)


def test_politeness():
    slept, answers = [], [{"status": 429, "retry_after": "3"}, {"status": 200}]
    assert fetch.politely(lambda _: answers.pop(0), "u", slept.append)["status"] == 200 and slept == [0.3, 3.0, 0.3]
    with pytest.raises(fetch.RateLimited):
        fetch.politely(lambda _: {"status": 503, "retry_after": "31"}, "u", slept.append)
    now = datetime(2024, 1, 1, tzinfo=UTC)
    assert [fetch.wait_asked(x, now) for x in (None, "7", "Mon, 01 Jan 2024 00:00:09 GMT", "Sun, 31 Dec 2023 00:00:00 GMT", "soon")] == [2.0, 7.0, 9.0, 0.0, 2.0]


def test_pages(spark):
    def fetcher(url):
        if "bad" in url:
            raise OSError("no route")
        return {"status": 404 if "gone" in url else 200, "body": "b"}

    df = spark.createDataFrame([("http://a/x",), ("http://a/x",), ("http://b/bad",), ("http://a/gone",), (None,)], "url string")
    assert {r.url: (r.status, r.body, r.error) for r in fetch.pages(df, fetcher, 0).collect()} == {"http://a/x": (200, "b", None), "http://b/bad": (None, None, "OSError: no route"), "http://a/gone": (404, None, "status 404")}


def test_local_files(spark, tmp_path):
    for name, text in (("a.md", "\n  ## Dev — Acme\nReq ID: R-77 remote"), ("b.html", "<title>Ops at Beta Corp</title><p>hi</p>"), ("c.txt", " \n ")):
        (tmp_path / name).write_text(text)
    rows = {r.path[-4:]: r for r in fetch.local_files(spark, str(tmp_path)).collect()}
    assert (rows["a.md"[-4:]].title, rows["a.md"[-4:]].company, rows["a.md"[-4:]].req_id, rows["a.md"[-4:]].remote) == ("Dev — Acme", "Acme", "R-77", True)
    assert (rows["html"].title, rows["html"].raw_text, rows["html"].company) == ("Ops at Beta Corp", "hi", "Beta Corp")
    assert rows[".txt"].error == "no text"


def test_dropped_html_gives_its_main_text(spark, tmp_path):
    """Navigation is no part of a posting: a word in it must not make a remote one local."""
    (tmp_path / "a.HTM").write_text("<title>Dev at Beta Corp</title><nav>hybrid jobs</nav><article><p>We are remote. $120k - $150k</p></article>")
    (r,) = fetch.local_files(spark, str(tmp_path)).collect()
    assert (r.title, r.company, r.raw_text, r.remote, r.comp.max) == ("Dev at Beta Corp", "Beta Corp", "We are remote. $120k - $150k", True, 150_000)


def test_ashby_job_is_named_by_the_last_segment(spark):
    body = '{"jobs":[{"id":"j7","title":"T","descriptionHtml":"<p>remote</p>"}]}'
    rows = [(u, None, body, None, None) for u in ("https://jobs.ashbyhq.com/b/j7", "https://jobs.ashbyhq.com/b/j7/", "https://jobs.ashbyhq.com/b/team/j7", "https://jobs.ashbyhq.com/b/j7/application", "https://jobs.ashbyhq.com/")]
    got = ingest.extract(spark.createDataFrame(rows, "url string, final_url string, api_body string, html string, fetch_error string")).collect()
    assert [r.posting and r.posting.title for r in got] == ["T", "T", "T", None, None]


@pytest.mark.parametrize(("before", "failures", "revision"), [(None, [], 1), (0, ["remote-only"], 1), (1, ["blacklist", "ideological"], 2), (1, [], 2)])
def test_a_snapshot_and_its_evaluation_share_a_revision(spark, before, failures, revision):
    df = spark.createDataFrame([(before, [(g, "why") for g in failures], None if failures else 50)], "r long, f array<struct<gate:string,reason:string>>, c long")
    for events in (decide.decide_ingest(F.lit(True), F.lit(None), F.col("r"), F.col("f"), F.col("c")), commands._judged(F.col("f"), F.col("c"), F.col("r"))):
        assert {e.revision for e in df.select(events.alias("e")).first().e if e.type in ("scored", "rejected")} == {revision}


def test_packages_without_a_resume(spark):
    book = spark.createDataFrame([(1, "apply-automatically", None), (2, "apply-automatically", 'https://ex.com/"x"'), (3, None, "u"), (4, "defer", None)], "lead_id long, latest_mark string, url string")
    got = {r.lead_id: r for r in commands.packages(book).collect()}
    assert (got[1].error, got[1].payload, got[1].value) == (None, '{"package":{"cheat_sheet":[]}}', '{"lead_id":"1","package":{"cheat_sheet":[]},"url":null}')
    assert json.loads(got[2].payload) == {"package": {"cheat_sheet": []}, "url": 'https://ex.com/"x"'} and [e.type for e in got[2].events] == ["apply_queued"]
    assert all((got[i].error, got[i].payload, got[i].value, got[i].events) == ("not marked apply-automatically", None, None, []) for i in (3, 4))


def test_raw_text_is_the_latest_snapshots(spark):
    rows = [(1, "a", "ingested", "v1"), (2, "a", "updated", "v2"), (3, "a", "reviewed", None), (4, "b", "ingested", None), (5, None, "discovery", None), (6, "c", "reviewed", None)]
    df = spark.createDataFrame(rows, "ordinal long, lead_id string, type string, t string").selectExpr("ordinal", "lead_id", "type", "named_struct('raw_text', t) as snapshot")
    assert {r.lead_id: r.raw_text for r in views.raw_text(df).collect()} == {"a": "v2", "b": None}
    assert [r.raw_text for r in views.raw_text(df, "a").collect()] == ["v2"] and views.raw_text(df, "c").count() == 0
