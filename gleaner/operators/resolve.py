"""Batch identity resolution: postings of one batch see the effects of earlier ones.

Postings interact only through identifiers that they share, so components over shared forms are
independent. Those with one posting need joins only; the others are replayed in order, as a posting can point an
identifier to another lead for those behind it. A component's rows are streamed in order, so a task holds the
identifiers that it has met, never a frame of rows.

Both sides of a join grow with the batch, so they are sorted and merged: a side that is just small enough to be broadcast
would pass through the driver, once for each join of each round.

A title and company alone find a lead only for a posting that has neither requisition nor url, so they link the
postings of a batch only where there is such a one among them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import keep as _keep
from .triage import lookup


def _components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component) by least labels with pointer jumping."""
    both = _keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = _keep(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("id", "b").hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near.hint("merge"), "id").select("id", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        up = labels.select(F.col("id").alias("to"), F.col("component").alias("above"))
        new = _keep(step.join(up.hint("merge"), "to", "left").select("id", F.least("to", "above").alias("component"), "was"))
        moved = new.where("component <> was").limit(1).count()
        labels = new.select("id", "component")
        if not moved:
            return labels
    raise RuntimeError("components did not settle")


def _replay(batches):
    """Rows (component, pos, req, url, tc, dedupe_key, known) in order of component and pos -> (pos, lead_id, is_new)."""
    at, here = None, {}
    for batch in batches:
        out = []
        for component, pos, req, url, tc, key, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if component != at:
                at, here = component, {}
            for form, lead in known or ():  # what the log knows counts until the batch points it elsewhere
                here.setdefault(form, lead)
            asked = (req, url, tc if req is None and url is None else None, key)
            lead = next((here[k] for k in asked if k is not None and k in here), None)
            out.append((pos, lead or f"new-{pos}", lead is None))
            here.update((k, out[-1][1]) for k in (req, url, tc, key) if k is not None)
        yield pa.record_batch([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.string(), pa.bool_()))], names=["pos", "lead_id", "is_new"])


def resolve(postings: DataFrame, index: DataFrame) -> DataFrame:
    """(pos, lead_id, is_new) for postings (pos, identity): an existing lead's id, or `new-<pos>` of the posting that made it.

    index: (form, lead_id). Postings that share no form with another are joined; the rest is replayed.
    """
    i = F.col("identity")
    postings = _keep(postings.select(F.col("pos").cast("long").alias("pos"), "identity"))
    bare = i["req"].isNull() & i["url"].isNull()
    forms = _keep(postings.select("pos", bare.alias("bare"), F.explode(F.array_distinct(F.array_compact(F.array(i["req"], i["url"], i["tc"], i["dedupe_key"])))).alias("form")))
    # a title and company that no posting asks for links nothing
    groups = forms.groupBy("form").agg(F.min("pos").alias("a"), F.max("bare").alias("asked"), F.count("*").alias("n"))
    groups = groups.where(F.col("n") > 1).where(F.col("asked") | ~F.col("form").startswith("tc:"))
    edges = forms.join(groups.hint("merge"), "form").where("a <> pos").select("a", F.col("pos").alias("b"))
    labels = _components(edges).withColumnRenamed("id", "pos")
    grouped = postings.join(labels.hint("merge"), "pos", "left")

    alone = lookup(grouped.where("component is null"), index).select("pos", F.coalesce("matched_lead", F.concat(F.lit("new-"), F.col("pos").cast("string"))).alias("lead_id"), F.col("matched_lead").isNull().alias("is_new"))
    own = forms.join(index.hint("merge"), "form").groupBy("pos").agg(F.collect_list(F.struct("form", "lead_id")).alias("known"))
    columns = ("component", "pos", i["req"].alias("req"), i["url"].alias("url"), i["tc"].alias("tc"), i["dedupe_key"].alias("dedupe_key"))
    together = grouped.where("component is not null").join(own.hint("merge"), "pos", "left").select(*columns, F.transform("known", lambda k: F.array(k["form"], k["lead_id"])).alias("known"))
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return alone.union(together.repartition(parts, "component").sortWithinPartitions("component", "pos").mapInArrow(_replay, "pos long, lead_id string, is_new boolean"))
