import json

import pytest
from pyspark.sql import functions as F

from gleaner.operators import discovery, ingest, run, triage, views
from gleaner.sources import config, eventlog, segments
from gleaner.streaming import fold

LD = '<script type="application/ld+json">{"@type":"JobPosting","title":"From LD at Beta","description":"<p>remote, pays $150,000 a year. Req ID: LD-7</p>"}</script>'
PAGES = {
    "https://boards-api.greenhouse.io/v1/boards/acme/jobs/1": json.dumps({"title": "API Dev", "id": 1, "content": "<p>remote $140,000 - $160,000 a year</p>"}),
    "https://boards-api.greenhouse.io/v1/boards/acme/jobs/2": '{"shape": "changed"}',
    "https://job-boards.greenhouse.io/acme/jobs/2": LD,
    "https://plain.example/x": "<title>Ops — Gamma</title><nav>menu</nav><article><p>We are fully remote.</p><p>Req ID: P-9</p></article><footer>end</footer>",
    "https://api.lever.co/v0/postings/delta/7": json.dumps({"text": "Moved", "id": "7", "descriptionPlain": "remote"}),
}


def _fetcher():
    """A function of its own, which workers get by value."""
    pages = PAGES

    def get(url):
        if "down" in url:
            raise OSError("no route")
        if url == "https://go.example/7":
            return {"status": 200, "final_url": "https://jobs.lever.co/delta/7", "body": "<p>shell</p>"}
        return {"status": 200, "body": pages[url]} if url in pages else {"status": 404}

    return get





def test_ingest_by_url(spark):
    urls = ["https://job-boards.greenhouse.io/acme/jobs/1", "https://job-boards.greenhouse.io/acme/jobs/2", "https://plain.example/x", "https://go.example/7", "https://down.example/", "https://jobs.lever.co/down/1", "https://gone.example/", "https://plain.example/x", None]
    got = {r.url: r for r in run.ingest_urls(spark.createDataFrame([(u,) for u in urls], "url string"), _fetcher(), 0).collect()}
    assert len(got) == 7
    p = lambda u: got[u].posting
    assert (p(urls[0]).adapter, p(urls[0]).title, p(urls[0]).company, p(urls[0]).req_id, p(urls[0]).remote, p(urls[0]).comp["max"], p(urls[0]).url) == ("greenhouse", "API Dev", "Acme", "1", True, 160000, urls[0])
    assert (p(urls[1]).adapter, p(urls[1]).title, p(urls[1]).company, p(urls[1]).req_id, p(urls[1]).remote, p(urls[1]).comp["min"]) == ("drop-in", "From LD at Beta", "Beta", "LD-7", True, 150000)
    assert (p(urls[2]).title, p(urls[2]).company, p(urls[2]).raw_text, p(urls[2]).req_id, p(urls[2]).source) == ("Ops — Gamma", "Gamma", "We are fully remote.\nReq ID: P-9", "P-9", "unknown")
    assert (p(urls[3]).adapter, p(urls[3]).title, p(urls[3]).url) == ("lever", "Moved", "https://jobs.lever.co/delta/7")
    assert [p(u) for u in urls[4:7]] == [None] * 3
    assert "OSError" in got[urls[4]].error and "OSError" in got[urls[5]].error and got[urls[6]].error == "status 404"


def test_main_text(spark):
    from gleaner.functions.extraction import main_text

    html = ["<div><p>short</p></div><div id=x><p>" + "long words " * 9 + "</p></div><form>sign up</form>", "<main>a<p>b</main>", "<title> T </title>", "", None, "<p>unclosed <b>bold"]
    got = [r.m for r in spark.createDataFrame([(h,) for h in html], "h string").select(main_text("h").alias("m")).collect()]
    assert [(m.title, m.text) for m in got] == [(None, ("long words " * 9).strip()), (None, "a\nb"), ("T", ""), (None, ""), (None, None), (None, "unclosed bold")]


def settings(**more):
    sources = {"free": {"enabled": True}, "paid": {"enabled": True, "query": {"q": 1}}, "off": {}}
    return config.Settings(triage.Config(remote_only=True, floor=100_000, blacklist=("bad.com", "Evil Inc")), sources=sources, **more)


def record(i, **more):
    return {"job_title": f"T{i}", "company": f"C{i}", "final_url": f"https://ex.com/{i}?utm_x=1", "remote": True, "min_annual_salary_usd": 120000, "description": "words", "discovered_at": f"2024-01-0{i}T00:00:00+01:00"} | more


def test_discover(spark, tmp_path):
    log, asked = str(tmp_path / "log"), []
    s = settings()
    data = [record(1), record(2, company="Evil Inc"), record(3), record(3, description="other words")]

    def post(query):
        asked.append(query)
        return json.dumps({"data": data, "metadata": {"truncated_results": 4}})

    free = run.FreeFeed(lambda: json.dumps({"jobs": [{"url": "https://plain.example/x"}, {"url": "https://gone.example/"}, {"url": "nowhere"}]}), _fetcher(), 0)
    sources = {"free": free, "paid": run.PaidFeed(s, "paid", post, lambda: None), "off": free}
    with pytest.raises(discovery.SpendRefused):
        run.discover(spark, log, s, sources, dry_run=True)
    assert run.discover(spark, log, s, sources, dry_run=True, ask=lambda names: False) is None and not asked
    want = {"new": 3, "updated": 1, "suppressed": 0, "rejected": 1, "failed": 1, "failed_sources": [], "truncated_results": 4, "unknown_workplace": 0, "unknown_salary": 1, "strict_would_drop": 1, "rejected_by_source": {"paid": 1}, "failed_source_reasons": {}, "credits_spent_by_source": {"paid": 4}}
    dry = run.discover(spark, log, s, sources, dry_run=True, yes=True).asDict()
    assert {k: dry[k] for k in want} == want and dry["dry_run"] and not segments.last(spark, log)
    # what the dry run has paid for is not asked for again
    real = run.discover(spark, log, s, sources).asDict()
    assert {k: real[k] for k in want if k not in ("credits_spent_by_source", "truncated_results")} == {k: v for k, v in want.items() if k not in ("credits_spent_by_source", "truncated_results")} and not real["credits_spent_by_source"]
    assert len(asked) == 1 and "discovered_at_gte" not in asked[-1]

    events = views.typed(segments.read(spark, log))
    kinds = [(r.type, r.seq) for r in events.orderBy("ordinal").collect()]
    assert [k for k, _ in kinds] == ["ingested", "scored", "ingested", "scored", "ingested", "rejected", "ingested", "scored", "updated", "scored", "discovery"] and [n for _, n in kinds] == [1, 2, 1, 2, 1, 2, 1, 2, 3, 4, 1]
    book = {r.extracted.title: r for r in views.lead_record(events.where("lead_id is not null")).collect()}
    assert set(book) == {"Ops — Gamma", "T1", "T2", "T3"} and book["T3"].source == "paid" and book["T3"].url == "https://ex.com/3" and book["T2"].latest_rejection.gate == "blacklist" and book["T3"].latest_score.revision == 2

    # the next run: the cursor, marks that hold, a source that fails
    t1 = book["T1"].lead_id
    mark = {"envelope_version": 1, "id": "m", "stream": f"lead/{t1}", "seq": 3, "type": "reviewed", "schema_version": 1, "occurred_at": "2024-02-01T00:00:00Z", "recorded_at": "2024-02-01T00:00:00Z", "correlation_id": "c", "payload": '{"mark":"ignore"}'}
    segments.append(spark.createDataFrame([mark], "envelope_version int, id string, stream string, seq long, type string, schema_version int, occurred_at string, recorded_at string, correlation_id string, payload string").withColumns({"ordinal": F.lit(0).cast("long"), "causation_id": F.lit(None).cast("string"), **{c: F.col(c).cast("timestamp") for c in ("occurred_at", "recorded_at")}}), log, 1)
    free.get = lambda: "{}"
    again = run.discover(spark, log, s, sources).asDict()
    assert asked[-1]["discovered_at_gte"] == "2024-01-02T23:00:00Z" and asked[-1]["q"] == 1
    assert (again["new"], again["updated"], again["suppressed"], again["rejected"], again["failed_sources"]) == (0, 2, 1, 1, ["free"])
    assert "no array" in again["failed_source_reasons"]["free"]
    assert run.discover(spark, log, s, sources, only="off").asDict()["failed_sources"] == ["off"]
    with pytest.raises(ValueError, match="no such source"):
        run.discover(spark, log, s, sources, only="none")
    state = views.aggregate_state(views.typed(segments.read(spark, log)).where("lead_id is not null"))
    assert state.where("latest_mark = 'ignore'").first().seq == 4


def test_selection_and_typed_errors(spark, tmp_path):
    book = spark.createDataFrame([("ab1", 1), ("ab2", 2), ("c", 3)], "lead_id string, first_seen int")
    assert views.select_lead(book, "c").lead_id == "c"
    with pytest.raises(views.NoSuchLead):
        views.select_lead(book, "x")
    with pytest.raises(views.AmbiguousLead, match="matches 2 leads: ab1, ab2"):
        views.select_lead(book, "ab")
    log = str(tmp_path / "log.jsonl")
    bad = {"envelope_version": 1, "id": "e", "stream": "lead/a", "seq": 1, "type": "ingested", "schema_version": 1, "occurred_at": "2024-01-01T00:00:00Z", "recorded_at": "2024-01-01T00:00:00Z", "correlation_id": "c", "payload": {"url": "u"}}
    eventlog.append(log, [bad], {})
    with pytest.raises(Exception, match="lacks a field"):
        views.typed(eventlog.read(spark, log)).collect()


def test_edit_and_rescore_errors(spark):
    state = spark.createDataFrame([], "lead_id string, exists boolean, revision long, snapshot struct<dedupe_key:string,adapter:string,source:string,url:string,raw_text:string,extracted:struct<title:string,company:string,req_id:string,location:string,remote:boolean,comp:struct<min:bigint,max:bigint,currency:string,period:string,raw:string>>>")
    rows = spark.createDataFrame([("x", "T", None, None, None, None, None, None, "s")], "lead_id string, title string, company string, req_id string, location string, remote boolean, comp struct<min:bigint,max:bigint,currency:string,period:string,raw:string>, url string, source string")
    assert ingest.edit(rows, state, spark.createDataFrame([], "form string, lead_id string"), triage.Config()).first().error == "no such lead"


def test_ranks_of_a_bulk_load(spark):
    """Leads of one score and one time, beyond a band of ids, among others; text ids too."""
    rows = [(i * 700, 5 if i % 3 else None, 0 if i % 2 else i % 7) for i in range(400)]
    df = spark.createDataFrame(rows, "lead_id long, latest_score long, t int").selectExpr("lead_id", "latest_score", "timestamp_seconds(t * 40000) as first_seen")
    want = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (-(r[1] or 0), r[2], r[0])), 1)}
    assert {r.lead_id: r["rank"] for r in views.ranked(df).collect()} == want
    text = df.withColumn("lead_id", df.lead_id.cast("string"))
    want = {str(r[0]): n for n, r in enumerate(sorted(rows, key=lambda r: (-(r[1] or 0), r[2], str(r[0]))), 1)}
    assert {r.lead_id: r["rank"] for r in views.ranked(text).collect()} == want


def test_stream_of_the_book(spark, tmp_path):
    """Micro-batches in log order give the batch view, the first-snapshot rule and queued packages with it."""
    from test_views_and_resolve import SCHEMA, random_log

    log = spark.createDataFrame(random_log(11), SCHEMA)
    for i in range(3):
        log.where(f"ordinal >= {i * 200} and ordinal < {i * 200 + 200}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = fold.book_to_table(stream, "streamed_book", str(tmp_path / "c"))
    q.awaitTermination(120)
    q.stop()
    last = {}
    for r in sorted(spark.table("streamed_book").collect(), key=lambda r: r.event_count):
        last[r.lead_id] = r
    want = {r.lead_id: r for r in views.lead_book(log).collect()}
    assert set(last) == set(want)
    for k, w in want.items():
        g = last[k]
        assert (g.latest_mark, g.deferral_count, g.apply_queued, g.latest_score, g.latest_rejection, g.latest_outcome, g.first_seen, g.last_event, g.event_count) == (w.latest_mark, w.deferral_count, w.apply_queued, w.latest_score, w.latest_rejection, w.latest_outcome and w.latest_outcome.type, w.first_seen, w.last_event, w.event_count)


def test_paid_feed_pushes_its_bound(spark, tmp_path):
    from gleaner.sources import feeds

    asked = str(tmp_path / "asked")
    data = [record(i) for i in range(1, 9)]

    def post(query):
        with open(asked, "a") as f:
            f.write(json.dumps(query) + "\n")
        found = [r for r in data if r["discovered_at"] >= query.get("discovered_at_gte", "")]
        return {"data": found[query["offset"] : query["offset"] + query["limit"]]}

    feeds.register(spark, post)
    feed = spark.read.format("paidfeed").option("query", '{"q":1}').load()
    assert feed.where("discovered_at >= '2024-01-05T00:00:00+01:00'").count() == 4
    assert feed.where("discovered_at > '2024-01-05T00:00:00+01:00' and position >= 1").count() == 3
    assert spark.read.format("paidfeed").option("budget", "3").load().count() == 3
    queries = [json.loads(x) for x in open(asked)]
    assert queries[0] == {"q": 1, "discovered_at_gte": "2024-01-05T00:00:00+01:00", "offset": 0, "limit": 500} and queries[-1]["limit"] == 3 and all("discovered_at_gte" in q for q in queries[:2])


def test_a_run_that_is_overtaken_decides_anew_and_pays_once(spark, tmp_path, monkeypatch):
    """Someone writes while the run fetches and while it decides: it is decided on what is there then."""
    log, asked, s = str(tmp_path / "log"), [], settings()
    other = str(tmp_path / "other")

    def post(query):
        asked.append(query)
        return json.dumps({"data": [record(1), record(3)]})

    feed = run.PaidFeed(s, "paid", post, lambda: None)
    run.discover(spark, other, s, {"free": feed, "paid": feed, "off": feed}, only="paid", now="2024-01-01T00:00:00Z")
    rows, real, n = segments.read(spark, other), ingest.ingest, []

    def overtaken(*a):
        if not n:
            n.append(segments.append(rows, log))
        return real(*a)

    monkeypatch.setattr(ingest, "ingest", overtaken)
    got = run.discover(spark, log, s, {"free": feed, "paid": feed, "off": feed}, only="paid").asDict()
    assert len(asked) == 2 and (got["new"], got["updated"]) == (0, 2) and segments.last(spark, log) == 2
    assert [(r.type, r.seq) for r in segments.read(spark, log, since=2).orderBy("ordinal").collect()] == [("updated", 3), ("scored", 4), ("updated", 3), ("scored", 4), ("discovery", 1)]


def test_pages_that_are_paid_for_outlive_a_run_that_fails(spark, tmp_path, monkeypatch):
    log, asked, s = str(tmp_path / "log"), [], settings()
    monkeypatch.setattr(discovery, "PAGE", 2)
    data = [record(i) for i in range(1, 6)]

    def post(query):
        asked.append((query["offset"], query["limit"]))
        return json.dumps({"data": data[query["offset"] :][: query["limit"]]})

    feed, fail = run.PaidFeed(s, "paid", post, lambda: None), ingest.ingest
    sources = {"free": feed, "paid": feed, "off": feed}

    def lost(*a):
        raise RuntimeError("the driver is lost")

    monkeypatch.setattr(ingest, "ingest", lost)
    feed.post = lambda q: post(q) if q["offset"] < 2 else (_ for _ in ()).throw(OSError("down"))
    with pytest.raises(RuntimeError, match="lost"):
        run.discover(spark, log, s, sources, only="paid")
    monkeypatch.setattr(ingest, "ingest", fail)
    feed.post = post
    got = run.discover(spark, log, s, sources, only="paid").asDict()
    assert asked == [(0, 2), (2, 2), (4, 2)] and got["new"] == 5 and got["credits_spent_by_source"] == {"paid": 3}
    # the inbox is done, the cursor has moved: the next run asks anew
    run.discover(spark, log, s, sources, only="paid")
    assert asked[3][0] == 0 and run.Inbox(spark, log, "paid").pages() == []
