"""Views over the given tables that stand for a log and for postings; the same in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_K = "cast(get_json_object(props, '$.k') as int)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log: ordinal, lead_id, type, occurred_at, recorded_at, mark, composite, gate, method, revision."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "ts", "user_id", "event_type", "value", f"{_K} as k").selectExpr("*", "k div 10 as d")
    return e.selectExpr(
        "event_id as ordinal", "user_id * 10 + k % 10 as lead_id", "ts as recorded_at", "ts - make_interval(0, 0, 0, cast(d as int)) as occurred_at",
        """case event_type when 'signup' then if(k % 2 = 0, 'ingested', 'updated') when 'view' then 'scored' when 'error' then 'rejected' when 'click' then 'reviewed'
           else case when d < 3 then 'apply_queued' when d < 7 then element_at(array('applied', 'screened', 'interviewed', 'offered'), cast(d - 2 as int))
           else element_at(array('accepted', 'rejected_by_employer', 'withdrawn', 'declined', 'unresponsive', 'archived'), cast((d - 7) * 2 + user_id % 2 + 1 as int)) end end as type""",
        "if(event_type = 'click', element_at(array('defer', 'ignore', 'apply-automatically', 'apply-manual'), cast(d % 4 + 1 as int)), null) as mark",
        "if(event_type = 'view', cast(floor(value) as bigint) % 101, null) as composite",
        "if(event_type = 'error', element_at(array('remote-only', 'compensation-floor', 'blacklist', 'ideological'), cast(d % 4 + 1 as int)), null) as gate",
        "if(event_type = 'purchase' and d = 3 and user_id % 2 = 0, 'referral', null) as method",
        "if(event_type in ('view', 'error'), d + 1, null) as revision",
    )


EVENTS_SQL = """v AS (
  SELECT event_id AS ordinal, user_id * 10 + k % 10 AS lead_id, ts AS recorded_at, ts - to_days(d::INT) AS occurred_at,
    CASE event_type WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'ingested' ELSE 'updated' END WHEN 'view' THEN 'scored' WHEN 'error' THEN 'rejected' WHEN 'click' THEN 'reviewed'
      ELSE CASE WHEN d < 3 THEN 'apply_queued' WHEN d < 7 THEN (['applied', 'screened', 'interviewed', 'offered'])[d - 2]
      ELSE (['accepted', 'rejected_by_employer', 'withdrawn', 'declined', 'unresponsive', 'archived'])[(d - 7) * 2 + user_id % 2 + 1] END END AS type,
    CASE WHEN event_type = 'click' THEN (['defer', 'ignore', 'apply-automatically', 'apply-manual'])[d % 4 + 1] END AS mark,
    CASE WHEN event_type = 'view' THEN floor(value)::BIGINT % 101 END AS composite,
    CASE WHEN event_type = 'error' THEN (['remote-only', 'compensation-floor', 'blacklist', 'ideological'])[d % 4 + 1] END AS gate,
    CASE WHEN event_type = 'purchase' AND d = 3 AND user_id % 2 = 0 THEN 'referral' END AS method,
    CASE WHEN event_type IN ('view', 'error') THEN d + 1 END AS revision
  FROM (SELECT *, k // 10 AS d FROM (SELECT *, (props::JSON ->> '$.k')::BIGINT AS k FROM events)))"""

_SNAP = "('ingested', 'updated', 'edited')"
_OUT = "('applied', 'screened', 'interviewed', 'offered', 'accepted', 'rejected_by_employer', 'withdrawn', 'declined', 'unresponsive', 'archived')"
_EVAL = "('ingested', 'updated', 'edited', 'scored', 'rejected')"

BOOK_SQL = f"""{EVENTS_SQL}, f AS (SELECT lead_id, min(ordinal) AS o1 FROM v WHERE type IN {_SNAP} GROUP BY lead_id),
b AS (SELECT lead_id,
    arg_max_null(mark, ordinal) FILTER (type = 'reviewed') AS latest_mark,
    count(*) FILTER (type = 'reviewed' AND mark = 'defer') AS deferral_count,
    coalesce(arg_max_null(type = 'apply_queued', ordinal) FILTER (type IN ('reviewed', 'apply_queued')), false) AS apply_queued,
    arg_max_null(CASE WHEN type = 'scored' THEN composite END, ordinal) FILTER (type IN {_EVAL}) AS latest_score,
    arg_max_null(CASE WHEN type = 'rejected' THEN gate END, ordinal) FILTER (type IN {_EVAL}) AS latest_rejection,
    arg_max_null(type, (occurred_at, ordinal)) FILTER (type IN {_OUT}) AS outcome,
    arg_max_null(method, (occurred_at, ordinal)) FILTER (type IN {_OUT}) AS outcome_method,
    arg_min(recorded_at, ordinal) FILTER (type IN {_SNAP}) AS first_seen, arg_max(recorded_at, ordinal) AS last_event, count(*) AS event_count
  FROM v JOIN f USING (lead_id) WHERE ordinal >= o1 GROUP BY lead_id),
s AS (SELECT *, CASE WHEN outcome = 'applied' THEN coalesce('applied (' || coalesce(outcome_method, CASE latest_mark WHEN 'apply-automatically' THEN 'auto-assisted' WHEN 'apply-manual' THEN 'manual' END) || ')', 'applied')
    WHEN outcome IS NOT NULL THEN outcome WHEN latest_mark = 'apply-automatically' THEN 'applying (auto-assisted)' WHEN latest_mark = 'apply-manual' THEN 'applying (manual)'
    WHEN latest_mark = 'defer' THEN 'deferred' WHEN latest_mark = 'ignore' THEN 'ignored' WHEN latest_score IS NOT NULL THEN 'pending' WHEN latest_rejection IS NOT NULL THEN 'rejected (gate)' ELSE 'ingested' END AS status,
    coalesce(outcome IN ('accepted', 'rejected_by_employer', 'withdrawn', 'declined', 'unresponsive', 'archived'), false) AS terminal,
    coalesce(latest_mark = 'ignore', false) AS buried, latest_rejection IS NOT NULL AND latest_score IS NULL AS gated FROM b)"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings made of parts and suppliers: pos, source, title, company, req_id, location, url, raw_text."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    n = s.count()
    p = table(spark, sf_dir, "part").selectExpr("p_partkey as k", "p_name", f"p_partkey % {n} as s_suppkey").join(s, "s_suppkey")
    # texts are made and read by all tasks, however few files or row groups the small rows of `part` lie in
    p = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")
    return p.selectExpr(
        "k as pos", "concat('feed', cast(k % 3 as string)) as source", "trim(concat(element_at(array('Staff', 'Senior', 'Junior', '', 'Principal'), cast(k % 5 + 1 as int)), ' ', p_name)) as title", "s_name as company",
        "if(k % 3 = 0, null, concat('R-', cast(k % 700 as string))) as req_id", "element_at(array(null, 'Remote, US', 'Berlin', 'Austin'), cast(k % 4 + 1 as int)) as location",
        "if(k % 7 = 0, null, concat('https://Jobs.example.com/p/', cast(k % 900 as string), '/?utm_source=x&b=', cast(k % 2 as string), '&a=1#top')) as url",
        """concat('We build things. ', case k % 6 when 0 then concat('pays $', cast(100 + k % 50 as string), ',000 - $', cast(130 + k % 50 as string), ',000 a year') when 1 then '$120k\u00a0-\u00a0$150k'
           when 2 then '$60 - $80 per hour' when 3 then '$130,000 base' when 4 then if(k % 12 = 4, 'from $150,000 - $110,000 a year', '') else '$5 - $7' end, '. ', case cast(floor(k / 6) as bigint) % 3 when 0 then '5+\u00a0years of\u00a0experience' when 1 then '3 years in business and 8 years experience' else '' end,
           '. ', case cast(floor(k / 2) as bigint) % 4 when 0 then 'This role is fully remote.' when 1 then 'This role is not remote.' when 2 then 'Hybrid schedule.' else 'Not\u00a0hybrid; remote.' end, ' Requisition\u00a0ID:\u00a0', if(k % 4 = 0, 'none', concat('REQ-', cast(k as string))), '. python and Java')  as raw_text""",
    )


#: What the extractors must find, from the templates' parameters alone.
POSTINGS_SQL = """p AS (SELECT k AS pos, 'feed' || (k % 3) AS source, trim((['Staff', 'Senior', 'Junior', '', 'Principal'])[k % 5 + 1] || ' ' || p_name) AS title, s_name AS company,
    CASE WHEN k % 3 <> 0 THEN 'R-' || (k % 700) END AS req_id, ([NULL, 'Remote, US', 'Berlin', 'Austin'])[k % 4 + 1] AS location,
    CASE WHEN k % 7 <> 0 THEN 'https://jobs.example.com/p/' || (k % 900) || '?a=1&b=' || (k % 2) END AS url,
    CASE k % 6 WHEN 0 THEN (100 + k % 50) * 1000 WHEN 1 THEN 120000 WHEN 2 THEN 60 * 2080 WHEN 3 THEN 130000 WHEN 4 THEN CASE WHEN k % 12 = 4 THEN 150000 END END AS cmin,
    CASE k % 6 WHEN 0 THEN (130 + k % 50) * 1000 WHEN 1 THEN 150000 WHEN 2 THEN 80 * 2080 WHEN 4 THEN CASE WHEN k % 12 = 4 THEN 110000 END END AS cmax,
    CASE WHEN k % 6 = 2 THEN 'hour' WHEN k % 6 < 4 OR k % 12 = 4 THEN 'year' END AS period,
    CASE (k // 6) % 3 WHEN 0 THEN 5 WHEN 1 THEN 8 END AS years,
    CASE (k // 2) % 4 WHEN 0 THEN true WHEN 1 THEN CASE WHEN k % 4 = 1 THEN true END WHEN 2 THEN false ELSE true END AS remote,
    CASE WHEN k % 4 <> 0 THEN 'REQ-' || k END AS found_req, k,
    CASE k % 6 WHEN 0 THEN '$' || (100 + k % 50) || ',000 - $' || (130 + k % 50) || ',000' WHEN 1 THEN '$120k\u00a0-\u00a0$150k' WHEN 2 THEN '$60 - $80' WHEN 3 THEN '$130,000' WHEN 4 THEN CASE WHEN k % 12 = 4 THEN '$150,000 - $110,000' END END AS comp_raw,
    'We build things. ' || CASE k % 6 WHEN 0 THEN 'pays $' || (100 + k % 50) || ',000 - $' || (130 + k % 50) || ',000 a year' WHEN 1 THEN '$120k\u00a0-\u00a0$150k' WHEN 2 THEN '$60 - $80 per hour' WHEN 3 THEN '$130,000 base' WHEN 4 THEN CASE WHEN k % 12 = 4 THEN 'from $150,000 - $110,000 a year' ELSE '' END ELSE '$5 - $7' END ||
      '. ' || CASE (k // 6) % 3 WHEN 0 THEN '5+\u00a0years of\u00a0experience' WHEN 1 THEN '3 years in business and 8 years experience' ELSE '' END || '. ' ||
      CASE (k // 2) % 4 WHEN 0 THEN 'This role is fully remote.' WHEN 1 THEN 'This role is not remote.' WHEN 2 THEN 'Hybrid schedule.' ELSE 'Not\u00a0hybrid; remote.' END || ' Requisition\u00a0ID:\u00a0' || CASE WHEN k % 4 = 0 THEN 'none' ELSE 'REQ-' || k END || '. python and Java' AS raw_text
  FROM (SELECT p_partkey AS k, p_name, p_partkey % (SELECT count(*) FROM supplier) AS sk FROM part) JOIN supplier ON s_suppkey = sk)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with whole payloads: also seq, note, snapshot, score and rejection, made of each event's ordinal."""
    e = events(spark, sf_dir)
    return e.selectExpr(
        "*", "ordinal as seq", "if(ordinal % 4 = 0, concat('n', cast(ordinal % 9 as string)), null) as note",
        """if(type in ('ingested', 'updated', 'edited'), named_struct('dedupe_key', concat('k:', cast(ordinal % 500 as string)),
             'identifiers', named_struct('req', if(ordinal % 3 = 0, null, concat('req:', cast(ordinal % 50 as string))), 'url', if(ordinal % 7 = 0, null, concat('url:', cast(ordinal % 200 as string))), 'tc', concat('tc:', cast(ordinal % 90 as string))),
             'adapter', element_at(array('drop-in', 'feed', 'user'), cast(ordinal % 3 + 1 as int)), 'source', concat('feed', cast(ordinal % 5 as string)), 'url', if(ordinal % 7 = 0, null, concat('https://ex.com/j/', cast(ordinal % 200 as string))), 'raw_text', concat('text ', cast(ordinal as string)),
             'extracted', named_struct('title', if(ordinal % 11 = 0, null, concat('Role ', cast(ordinal % 97 as string), if(ordinal % 10 = 0, concat(' at Co ', cast(ordinal % 13 as string)), ''))), 'company', if(ordinal % 6 = 0, null, concat('Co ', cast(ordinal % 13 as string))), 'req_id', if(ordinal % 3 = 0, null, concat('R', cast(ordinal % 50 as string))),
               'location', element_at(array(null, 'Oslo', 'Remote'), cast(ordinal % 3 + 1 as int)), 'remote', element_at(array(true, false, null), cast(ordinal % 3 + 1 as int)),
               'comp', if(ordinal % 2 = 0, null, named_struct('min', 100000 + ordinal % 7 * 1000, 'max', 140000 + ordinal % 7 * 1000, 'currency', 'USD', 'period', 'year', 'raw', concat('$', cast(100 + ordinal % 7 as string), 'k'))))), null) as snapshot""",
        "if(type = 'scored', named_struct('composite', composite, 'revision', revision, 'breakdown', concat(cast(composite as string), ' = all')), null) as score",
        "if(type = 'rejected', named_struct('gate', gate, 'reason', concat('because ', gate), 'revision', revision), null) as rejection",
    )


#: What the latest snapshot of a lead holds, from its ordinal `so`; `g`, `gr`: the latest rejection's ordinal and revision.
RECORD_SQL = f"""{BOOK_SQL}, x AS (SELECT lead_id, arg_max_null(ordinal, ordinal) FILTER (type IN {_SNAP}) AS so,
    arg_max_null(CASE WHEN type = 'scored' THEN revision END, ordinal) FILTER (type IN {_EVAL}) AS score_revision, arg_max_null(CASE WHEN type = 'rejected' THEN revision END, ordinal) FILTER (type IN {_EVAL}) AS gate_revision,
    arg_max_null(CASE WHEN ordinal % 4 = 0 THEN 'n' || (ordinal % 9) END, (occurred_at, ordinal)) FILTER (type IN {_OUT}) AS outcome_note, max((occurred_at, ordinal)) FILTER (type IN {_OUT}) AS oa
  FROM v JOIN f USING (lead_id) WHERE ordinal >= o1 GROUP BY lead_id),
r AS (SELECT s.*, so, score_revision, gate_revision, outcome_note, oa[1] AS outcome_at, 'k:' || (so % 500) AS dedupe_key, CASE WHEN so % 3 <> 0 THEN 'req:' || (so % 50) END AS form_req, CASE WHEN so % 7 <> 0 THEN 'url:' || (so % 200) END AS form_url, 'tc:' || (so % 90) AS form_tc,
    (['drop-in', 'feed', 'user'])[so % 3 + 1] AS adapter, 'feed' || (so % 5) AS source, CASE WHEN so % 7 <> 0 THEN 'https://ex.com/j/' || (so % 200) END AS url, 'text ' || so AS raw_text,
    CASE WHEN so % 11 <> 0 THEN 'Role ' || (so % 97) || CASE WHEN so % 10 = 0 THEN ' at Co ' || (so % 13) ELSE '' END END AS title, CASE WHEN so % 6 <> 0 THEN 'Co ' || (so % 13) END AS company, CASE WHEN so % 3 <> 0 THEN 'R' || (so % 50) END AS req_id,
    ([NULL, 'Oslo', 'Remote'])[so % 3 + 1] AS location, ([true, false, NULL])[so % 3 + 1] AS remote, CASE WHEN so % 2 = 1 THEN 140000 + so % 7 * 1000 END AS comp_max, CASE WHEN so % 2 = 1 THEN '$' || (100 + so % 7) || 'k' END AS comp_raw
  FROM s JOIN x USING (lead_id))"""
