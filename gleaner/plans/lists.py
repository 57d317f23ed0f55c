"""Registered queries of gates over long lists; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lists
from .inputs import POSTINGS_SQL, postings, table
from .queries import query


@query(f"""WITH {POSTINGS_SQL}, b AS (SELECT s_suppkey AS at, CASE WHEN s_suppkey % 2 = 0 THEN right(s_name, 9) || ', SUPPLIER' ELSE replace(s_name, '#', '') END AS entry, s_name FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT pos, entry FROM p JOIN b ON company = s_name""")
def blacklist_table(spark, d):
    """Two of three suppliers are listed, in other spellings: turned round, or without what parts the words."""
    k = F.col("s_suppkey")
    name = F.when(k % 2 == 0, F.concat(F.expr("right(s_name, 9)"), F.lit(", SUPPLIER"))).otherwise(F.replace("s_name", F.lit("#"), F.lit("")))
    entries = table(spark, d, "supplier").where(k % 3 != 0).select(k.alias("at"), name.alias("entry"))
    p = postings(spark, d)
    return p.join(lists.blacklisted(p, entries), "company").select("pos", "entry")


@query(f"""WITH {POSTINGS_SQL} SELECT pos, 'posting matches red line ''req-' || k || '. PYTHON'': …REQ-' || k || '. python and Java…' AS reason FROM p WHERE k % 4 <> 0""")
def red_line_table(spark, d):
    """A line for each posting that states a requisition: as many lines as there are, as a table."""
    p = postings(spark, d)
    lines = p.where("pos % 4 <> 0").select(F.col("pos").alias("at"), F.concat(F.lit("req-"), F.col("pos").cast("string"), F.lit(". PYTHON")).alias("line"))
    return lists.red_lined_by(p, lines, "pos", "raw_text").select("pos", "reason")
