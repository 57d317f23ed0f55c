"""More registered queries: structured records and commands, with their SQL from the templates' parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records
from ..operators import commands
from .inputs import BOOK_SQL, EVENTS_SQL, POSTINGS_SQL, events, postings, table
from .queries import CONFIG, _book, _extracted, query, triage

_LD = """concat('<html><script type="application/ld+json">{broken</script><script type="application/ld+json">', if(pos % 3 = 0, '[', if(pos % 3 = 1, '{"@graph":[{"@type":"Organization"},', '')),
 '{"@type":', if(pos % 2 = 0, '"JobPosting"', '["Thing","jobposting"]'), if(pos % 11 = 0, '', concat(',"title":"T', pos, '"')), ',"hiringOrganization":{"name":"Acme"},"jobLocation":', if(pos % 4 = 0, '"Oslo"', '{"address":{"addressLocality":"Oslo","addressCountry":"NO"}}'),
 ',"jobLocationType":"', element_at(array('TELECOMMUTE', 'onsite', 'x'), cast(pos % 3 + 1 as int)), '","baseSalary":{"value":{"minValue":', if(pos % 5 = 0, '"x"', concat(50 + pos % 50, '.5')), ',"unitText":"', if(pos % 2 = 0, 'HOUR', 'YEAR'), '"}}}',
 if(pos % 3 = 0, ']', if(pos % 3 = 1, ']}', '')), '</script></html>')"""


@query(f"""WITH {POSTINGS_SQL} SELECT pos, CASE WHEN k % 11 <> 0 THEN 'T' || k END AS title, CASE WHEN k % 11 <> 0 THEN CASE WHEN k % 4 = 0 THEN 'Oslo' ELSE 'Oslo, NO' END END AS location,
CASE WHEN k % 11 <> 0 THEN CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END END AS remote, CASE WHEN k % 11 <> 0 AND k % 5 <> 0 THEN (51 + k % 50) * CASE WHEN k % 2 = 0 THEN 2080 ELSE 1 END END AS low FROM p""")
def json_ld_postings(spark, d):
    return postings(spark, d).select("pos", records.json_ld(F.expr(_LD)).alias("j")).select("pos", "j.title", "j.location", "j.remote", F.col("j.comp.min").alias("low"))


@query(f"""WITH {POSTINGS_SQL} SELECT pos, 'T' || k AS title, k::VARCHAR AS req_id, CASE WHEN k % 4 = 0 THEN true WHEN k % 4 < 3 THEN false END AS remote, CASE WHEN k % 2 = 0 THEN 120000 END::BIGINT AS low FROM p""")
def ashby_board_jobs(spark, d):
    board = """concat('{"jobs":[{"id":"other","title":"no"},{"id":', pos, ',"title":"T', pos, '","workplaceType":"', element_at(array('remote', 'Hybrid', 'OnSite', 'Moon'), cast(pos % 4 + 1 as int)), '","descriptionHtml":"<p>We build.</p>"',
      if(pos % 2 = 0, ',"compensation":{"compensationTierSummary":"$120k - $150k"}', ''), '}]}')"""
    a = postings(spark, d).select("pos", records.ashby(F.expr(board), F.lit("acme"), F.col("pos").cast("string")).alias("api"))
    return records.finalize(a, "api", "f").select("pos", "f.title", "f.req_id", "f.remote", F.col("f.comp.min").alias("low"))


_PAID = """concat('{"data":[{"job_title":"T', pos, '","company_object":{"name":"Acme"},"final_url":"https://Ex.com/j/', pos, '/?utm_a=1","remote":', element_at(array('true', 'false', 'null', 'null'), cast(pos % 4 + 1 as int)), ',"hybrid":', if(pos % 4 in (0, 2), 'true', 'null'),
 ',"min_annual_salary_usd":', if(pos % 5 = 0, 'null', '120000.4'), ',"description":"fully remote, pays $120,000 a year","discovered_at":"2024-01-0', pos % 9 + 1, 'T00:00:00Z"}],"metadata":{"truncated_results":', pos % 7, '}}')"""


@query(f"""WITH {POSTINGS_SQL} SELECT pos, 'T' || k AS title, 'Acme' AS company, 'https://ex.com/j/' || k AS url, CASE k % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS remote, CASE WHEN k % 5 <> 0 THEN 120000 END::BIGINT AS low,
array_to_string(list_concat(CASE WHEN k % 5 = 0 THEN ['comp'] ELSE [] END, CASE WHEN k % 4 <> 0 THEN ['remote'] ELSE [] END), ',') AS mismatches, (k % 7)::BIGINT AS truncated FROM p""")
def paid_feed_records(spark, d):
    p = postings(spark, d).select("pos", F.expr(_PAID).alias("j"))
    p = p.select("pos", records.truncated("j").alias("truncated"), F.explode(records.paid_records("j")).alias("r"))
    return p.select("pos", "r.title", "r.company", "r.url", "r.remote", F.col("r.comp.min").alias("low"), F.array_join(records.mismatches("r"), ",").alias("mismatches"), "truncated")


@query(f"""WITH {POSTINGS_SQL} SELECT pos, 'https://ex.com/' || k AS url FROM p WHERE k % 3 <> 0""")
def free_feed_links(spark, d):
    feed = """concat('{"jobs":[{"url":"', if(pos % 3 = 0, 'nowhere', concat('https://ex.com/', pos)), '"},{"url":5},{}]}')"""
    return postings(spark, d).select("pos", F.explode(records.free_links(F.expr(feed))).alias("url"))


@query(f"""WITH {POSTINGS_SQL} SELECT pos, CASE WHEN k % 13 = 0 THEN 'no such lead' WHEN k % 5 <> 0 AND k % 2 = 0 THEN 'nothing to edit' END AS error,
array_to_string(list_concat(list_concat(CASE WHEN k % 5 = 0 THEN ['title'] ELSE [] END, CASE WHEN k % 2 = 1 THEN ['source'] ELSE [] END), CASE WHEN k % 3 <> 0 THEN ['adapter'] ELSE [] END), ',') AS changed,
CASE WHEN k % 13 = 0 OR (k % 5 <> 0 AND k % 2 = 0) THEN 0 ELSE 2 END::BIGINT AS events, CASE WHEN k % 13 <> 0 AND (k % 5 = 0 OR k % 2 = 1) THEN k % 4 + 1 END::BIGINT AS revision FROM p""")
def decide_edit_events(spark, d):
    p = triage.with_score(_extracted(spark, d), CONFIG)
    k = F.col("pos")
    fields = [F.col(f) for f in triage.FIELDS[1:]]
    p = p.withColumns({
        "new": F.struct(*triage.FIELDS, "source"),
        "old": F.struct(F.when(k % 5 == 0, "other").otherwise(F.col("title")).alias("title"), *fields, F.when(k % 2 == 1, "elsewhere").otherwise(F.col("source")).alias("source"), F.when(k % 3 == 0, "user").otherwise("feed").alias("adapter")),
    })
    passed = F.array().cast("array<struct<gate:string,reason:string>>")
    e = commands.decide_edit("old", "new", passed, F.col("composite"), k % 13 != 0, k % 4)
    return p.withColumn("e", e).select("pos", "e.error", F.array_join("e.changed", ",").alias("changed"), F.size("e.events").cast("long").alias("events"), F.array_max(F.transform("e.events", lambda x: x["revision"])).alias("revision"))


@query(f"""WITH {BOOK_SQL} SELECT lead_id, CASE WHEN lead_id % 6 = 5 THEN 'unknown outcome' WHEN lead_id % 6 = 4 THEN 'reason is for archived only' END AS error,
CASE WHEN lead_id % 6 < 4 THEN CASE WHEN lead_id % 6 = 3 THEN 'referral' WHEN latest_mark = 'apply-automatically' THEN 'auto-assisted' WHEN latest_mark = 'apply-manual' THEN 'manual' END END AS method FROM s""")
def decide_outcome_events(spark, d):
    k = F.col("lead_id") % 6
    e = commands.decide_outcome(F.when(k == 5, "eaten").otherwise("applied"), F.lit(True), F.col("latest_mark"), F.when(k == 3, "referral"), F.lit(None).cast("string"), F.when(k == 4, "old"))
    return _book(spark, d).withColumn("e", e).select("lead_id", "e.error", "e.method")


@query(f"WITH {BOOK_SQL} SELECT lead_id, CASE WHEN latest_mark IS DISTINCT FROM 'apply-automatically' THEN 'not marked apply-automatically' END AS error FROM s")
def decide_package_guard(spark, d):
    return _book(spark, d).select("lead_id", commands.decide_package(F.lit(True), F.col("latest_mark"))["error"].alias("error"))


@query(f"""WITH {EVENTS_SQL}, n AS (SELECT lead_id, revision, count(*) FILTER (type = 'rejected') AS rejections, count(*) FILTER (type = 'scored') AS scores FROM v WHERE type IN ('scored', 'rejected') GROUP BY ALL)
SELECT * FROM n WHERE scores > 1 OR (scores = 1 AND rejections > 0)""")
def pass_marker_faults(spark, d):
    return commands.pass_marker_faults(events(spark, d), ["lead_id", "revision"])


@query(f"""WITH {EVENTS_SQL}, x AS (SELECT lead_id, arg_max_null(CASE WHEN type = 'scored' THEN composite END, ordinal) AS a FROM v WHERE type IN ('scored', 'rejected') GROUP BY lead_id),
y AS (SELECT CASE WHEN lead_id % 3 = 0 THEN CASE WHEN a IS NULL THEN 'unchanged' ELSE 'newly_rejected' END WHEN a IS NULL THEN 'revived' WHEN a = (a * 7) % 101 THEN 'unchanged' ELSE 'changed' END AS delta FROM x)
SELECT count(*) AS evaluated, count(*) FILTER (delta = 'changed') AS changed, count(*) FILTER (delta = 'unchanged') AS unchanged, count(*) FILTER (delta = 'newly_rejected') AS newly_rejected, count(*) FILTER (delta = 'revived') AS revived FROM y""")
def rescore_summary(spark, d):
    from .queries import rescore_delta

    return commands.rescore_summary(rescore_delta(spark, d))


@query("SELECT s_suppkey, 'Full name=' || s_name || ';Location=Oslo, NO' AS sheet FROM supplier")
def cheat_sheet(spark, d):
    resume = F.concat(F.lit('{"basics":{"name":"'), "s_name", F.lit('","phone":5,"location":{"city":"Oslo","countryCode":"NO"}},"work":[]}'))
    sheet = F.transform(commands.cheat_sheet(resume), lambda x: F.concat(x["question"], F.lit("="), x["answer"]))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(sheet, ";").alias("sheet"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 101 <= 50 THEN 255 ELSE floor((100 - s_suppkey % 101) * 255 / 50.0)::INT END AS r, CASE WHEN s_suppkey % 101 >= 50 THEN 255 ELSE floor((s_suppkey % 101) * 255 / 50.0)::INT END AS g FROM supplier")
def score_colour(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", commands.score_rgb(F.col("s_suppkey") % 101).alias("c")).select("s_suppkey", "c.r", "c.g")


@query(f"""WITH {POSTINGS_SQL} SELECT pos, CASE WHEN k % 9 <> 0 THEN 'T' || k END AS title, CASE WHEN k % 9 <> 0 THEN 'Acme Corp' END AS company, CASE WHEN k % 9 <> 0 THEN k::VARCHAR END AS req_id,
CASE WHEN k % 9 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'intro' || chr(10) || 'one' || chr(10) || 'two & three' || CASE WHEN k % 3 = 0 THEN chr(10) || 'more' ELSE '' END ELSE '<p>intro</p><li>one</li><li>two &amp; three</li>' || CASE WHEN k % 5 = 0 THEN 'tail' ELSE '' END END END AS body FROM p""")
def lever_board_jobs(spark, d):
    j = """concat('{"id":"', pos, '",', if(pos % 9 = 0, '', concat('"text":"T', pos, '",')), if(pos % 2 = 0, concat('"descriptionPlain":"intro",', if(pos % 3 = 0, '"additionalPlain":"more",', '')), concat('"description":"<p>intro</p>",', if(pos % 5 = 0, '"additional":"tail",', ''))),
      '"lists":[{"content":"<li>one</li>"},{},{"content":"<li>two &amp; three</li>"}],"categories":{"location":"Oslo"}}')"""
    return postings(spark, d).select("pos", records.lever(F.expr(j), F.lit("acme-corp")).alias("a")).select("pos", "a.title", "a.company", "a.req_id", "a.body")


@query(f"""WITH {POSTINGS_SQL} SELECT pos, CASE WHEN k % 7 <> 0 THEN 'T' || k END AS title, CASE WHEN k % 7 <> 0 THEN (['Big Co', 'Named', 'Other Name'])[k % 3 + 1] END AS company, CASE WHEN k % 7 <> 0 THEN 'JR' || k END AS req_id, CASE WHEN k % 7 <> 0 THEN '<p>x</p>' END AS body FROM p""")
def workday_board_jobs(spark, d):
    j = """concat('{"', if(pos % 7 = 0, 'x', 'jobPostingInfo'), '":{"title":"T', pos, '","jobReqId":"JR', pos, '",', element_at(array('', '"company":"Named",', '"company":5,"companyName":"Other Name",'), cast(pos % 3 + 1 as int)), '"jobDescription":"<p>x</p>"}}')"""
    return postings(spark, d).select("pos", records.workday(F.expr(j), F.lit("big-co")).alias("a")).select("pos", "a.title", "a.company", "a.req_id", "a.body")


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey ELSE 0 END::BIGINT AS unreturned FROM supplier")
def refused_credits(spark, d):
    k = F.col("s_suppkey")
    body = F.when(k % 3 == 0, F.concat(F.lit('{"error":{"description":"Not enough. Required: '), k.cast("string"), F.lit(' API credits"}}'))).when(k % 3 == 1, '{"error":{}}').otherwise("no json")
    return table(spark, d, "supplier").select("s_suppkey", records.unreturned(body).alias("unreturned"))


@query("SELECT s_suppkey, 'a' || s_name || 'b c' AS clean FROM supplier")
def sanitized(spark, d):
    from ..functions.text import sanitize

    return table(spark, d, "supplier").select("s_suppkey", sanitize(F.concat(F.lit("a\x1b\x07"), "s_name", F.lit("\x85b\n c\x7f"))).alias("clean"))


@query(f"""WITH {EVENTS_SQL} SELECT ordinal, '{{"ordinal_":' || ordinal || ',"lead_id":' || lead_id || ',"type":"' || type || '"' || CASE WHEN composite IS NOT NULL THEN ',"composite":' || composite ELSE '' END || '}}' AS value FROM v WHERE type = 'scored' OR lead_id % 10 = 3""")
def event_dump(spark, d):
    e = events(spark, d).select("ordinal", F.col("ordinal").alias("ordinal_"), "lead_id", "type", "composite")
    lines = commands.dump(e, kind="scored").union(commands.dump(e.where("lead_id % 10 = 3 and type <> 'scored'")))
    return lines.select(F.get_json_object("value", "$.ordinal_").cast("long").alias("ordinal"), "value")


@query(f"WITH {POSTINGS_SQL} SELECT pos, 'New' AS title, company, NULL::VARCHAR AS location, CASE WHEN cmin IS NOT NULL OR cmax IS NOT NULL THEN cmin END::BIGINT AS low, 5::BIGINT AS high, NULL::BOOLEAN AS remote FROM p")
def patched_fields(spark, d):
    p = commands.patched(_extracted(spark, d), {"title": "New", "comp": {"max": 5}, "remote": None}, {"location"})
    return p.select("pos", "title", "company", "location", F.col("comp.min").alias("low"), F.col("comp.max").alias("high"), "remote")
