"""The lead book as a stream: the state of each lead is a list of sums and latest values, never a log.

Outcomes are compared by occurred_at and then by order, so late ones are kept and don't set a lead back; there is no
watermark that would drop them.

marks_and_outcomes() is an aggregate, for rows in any order of arrival; it counts all events of a lead. book() keeps the
whole rule of the book, by which events before a lead's first snapshot don't count: that needs the log's order, in
which a log's stream comes, and a state of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.views import EVALUATIONS, OUTCOMES, SNAPSHOTS


def marks_and_outcomes(events: DataFrame) -> DataFrame:
    """Latest mark, outcome and score by lead, and counts, for streams and batches alike."""
    t, o = F.col("type"), F.col("ordinal")
    return events.groupBy("lead_id").agg(
        F.max(F.when(t == "reviewed", F.struct(o.alias("o"), F.col("mark").alias("v"))))["v"].alias("latest_mark"),
        F.max(F.when(t.isin(OUTCOMES), F.struct(F.col("occurred_at").alias("at"), o.alias("o"), t.alias("v"))))["v"].alias("latest_outcome"),
        F.max(F.when(t.isin(EVALUATIONS), F.struct(o.alias("o"), F.when(t == "scored", F.col("composite")).alias("v"))))["v"].alias("latest_score"),
        F.count_if(t.isin(SNAPSHOTS)).alias("snapshots"),
        F.count("*").alias("events"),
    )


def to_table(stream: DataFrame, name: str, checkpoint: str):
    """Start the fold of a stream into a table in memory; read all that there is, then stop."""
    return marks_and_outcomes(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_BOOK = "lead_id {id}, latest_mark string, deferral_count long, apply_queued boolean, latest_score long, latest_rejection string, latest_outcome string, first_seen timestamp, last_event timestamp, event_count long"
_STATE = "mark string, deferrals long, queued boolean, score long, gate string, outcome string, outcome_at timestamp, first timestamp, last timestamp, n long"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Events of one micro-batch, in log order, onto a lead's state; nothing until the lead has a snapshot."""
    s = dict(zip(_FIELDS, state.get, strict=True)) if state.exists else None
    rows = sorted((r for f in frames for r in f.to_dict("records")), key=lambda r: r["ordinal"])
    for r in rows:
        kind = r["type"]
        if s is None:
            if kind not in SNAPSHOTS:
                continue
            s = dict.fromkeys(_FIELDS) | {"deferrals": 0, "queued": False, "first": r["recorded_at"], "n": 0}
        s["n"], s["last"] = s["n"] + 1, r["recorded_at"]
        if kind in EVALUATIONS:
            s["score"], s["gate"] = (int(r["composite"]) if kind == "scored" else None), (r["gate"] if kind == "rejected" else None)
        elif kind == "reviewed":
            s["mark"], s["queued"], s["deferrals"] = r["mark"], False, s["deferrals"] + (r["mark"] == "defer")
        elif kind == "apply_queued":
            s["queued"] = True
        elif kind in OUTCOMES and (s["outcome_at"] is None or r["occurred_at"] >= s["outcome_at"]):
            s["outcome"], s["outcome_at"] = kind, r["occurred_at"]
    if s is not None:
        state.update(tuple(s[f] for f in _FIELDS))
        yield pd.DataFrame({"lead_id": [key[0]], "latest_mark": [s["mark"]], "deferral_count": [s["deferrals"]], "apply_queued": [s["queued"]], "latest_score": pd.array([s["score"]], "Int64"), "latest_rejection": [s["gate"]], "latest_outcome": [s["outcome"]], "first_seen": [s["first"]], "last_event": [s["last"]], "event_count": [s["n"]]})


_FIELDS = [f.split()[0] for f in _STATE.split(", ")]


def book(events: DataFrame) -> DataFrame:
    """The book's rows of the leads that a micro-batch touched; a stream in the log's order."""
    kind = dict(events.dtypes)["lead_id"]
    return events.groupBy("lead_id").applyInPandasWithState(_fold, _BOOK.replace("{id}", kind), _STATE, "update", GroupStateTimeout.NoTimeout)


def book_to_table(stream: DataFrame, name: str, checkpoint: str):
    """Start book() into a table in memory, a row for each update; read all that there is, then stop."""
    return book(stream).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
