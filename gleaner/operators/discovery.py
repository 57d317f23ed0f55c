"""Feeds: watermarks, run summaries, null rates, and the budgeted paging of a paid source."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 500


def prior_watermarks(runs: DataFrame) -> DataFrame:
    """(source, watermark): each source's value in the newest run that has one. runs: ordinal, discovered_at map."""
    return runs.select("ordinal", F.explode("discovered_at").alias("source", "watermark")).groupBy("source").agg(F.max_by("watermark", "ordinal").alias("watermark"))


def run_summary(results: DataFrame) -> DataFrame:
    """Counts of a run's postings by what became of them; a rejected one counts as rejected only."""
    kinds = ["new", "updated", "suppressed", "rejected", "failed"]
    return results.groupBy("source").agg(*(F.count_if(F.col("result") == k).alias(k) for k in kinds))


def null_rates(postings: DataFrame, remote_only: bool = True, floor: int | None = 0, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """Postings without a word on remote work or pay; strict_would_drop: those that strict filters of the gates in force would lose."""
    unknown_remote, unknown_comp = F.col("remote").isNull(), F.col("comp").isNull()
    dropped = (F.lit(remote_only) & unknown_remote) | (F.lit(floor is not None) & unknown_comp)
    return postings.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(unknown_remote).alias("unknown_remote"), F.count_if(unknown_comp).alias("unknown_comp"), F.count_if(dropped).alias("strict_would_drop"))


def newest(times) -> Column:
    """The largest of a source's times as text, as an aggregate."""
    return F.max(times)


def _by_source(value: Column, when: Column) -> Column:
    """A map in order of sources, as an aggregate."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.when(when, F.struct(F.col("source"), value)))))


def fetch_facts(fetches: DataFrame) -> DataFrame:
    """One row: what a run's fetches were like. fetches: position, source, failed, truncated, credits, discovered_at, error.

    A source with an error is a failed one, whether its records are there or not.
    """
    bad = F.col("error").isNotNull()
    named = F.array_sort(F.collect_list(F.when(bad, F.struct("position", "source"))))
    return fetches.agg(
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"), F.coalesce(F.sum("truncated"), F.lit(0)).alias("truncated_results"), F.transform(named, lambda x: x["source"]).alias("failed_sources"),
        _by_source(F.col("error"), bad).alias("failed_source_reasons"), _by_source(F.col("credits"), F.col("credits") > 0).alias("credits_spent_by_source"), _by_source(F.col("discovered_at"), F.col("discovered_at").isNotNull()).alias("discovered_at"),
    )


def batch_summary(results: DataFrame, facts: DataFrame, remote_only: bool, floor: int | None, dry_run: bool = False) -> DataFrame:
    """One row of a run: results are rows of ingest.ingest (with remote and comp), facts one of fetch_facts()."""
    rejected = F.coalesce(F.size("rejected"), F.lit(0)) > 0
    kind = lambda k: F.count_if(~rejected & (F.col("kind") == k))
    counts = results.agg(kind("ingested").alias("new"), kind("updated").alias("updated"), kind("reingest_suppressed").alias("suppressed"), F.count_if(rejected).alias("rejected"))
    by = results.where(rejected).groupBy("source").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("rejected_by_source"))
    rates = null_rates(results, remote_only, floor, ()).select(F.col("unknown_remote").alias("unknown_workplace"), F.col("unknown_comp").alias("unknown_salary"), "strict_would_drop")
    out = counts
    for one in (by, rates, facts):  # a row each
        out = out.join(F.broadcast(one))
    return out.withColumn("dry_run", F.lit(dry_run))


def run_event(summary: DataFrame) -> DataFrame:
    """(payload): the run's event as JSON; maps without an entry are left out."""
    full = lambda m: F.when(F.size(m) > 0, F.col(m)).alias(m)
    return summary.select(F.to_json(F.struct("new", "updated", "suppressed", "rejected", "failed", "failed_sources", full("discovered_at"), full("failed_source_reasons"))).alias("payload"))


class SpendRefused(Exception):
    """A preview would spend credits and no one said yes."""


def spend_gate(dry_run: bool, yes: bool, json: bool, terminal: bool, paid: list[str]) -> str:
    """`proceed` or `prompt`; raises where a paid preview must not be asked about: its fetch costs what a real one does."""
    if not dry_run or not paid or yes:
        return "proceed"
    if json or not terminal:
        why = "a prompt would corrupt JSON output" if json else "there is no one to ask"
        raise SpendRefused(f"a dry run of a paid source ({', '.join(paid)}) would spend credits; {why}: authorise it")
    return "prompt"


class CreditsExhausted(Exception):
    def __init__(self, required: int = 0):
        self.required = required


@dataclass
class Fetched:
    records: list = field(default_factory=list)
    spent: int = 0
    truncated: int = 0
    error: str | None = None


def fetch_within_budget(page: Callable[[int, int], tuple[list, int]], balance: Callable[[], int | None], budget: int | None = None, start: int = 0) -> Fetched:
    """Read pages (offset, limit) -> (records, more matches) until the source, the balance or the budget ends.

    No credit before the first page is an error; none later means one more request without that bound, which tells how
    much is left. start: records of the query that are there already, behind which it goes on. A refusal for credits ends the run with what there is, as does any error after a first record.
    """
    out, first = Fetched(), True
    while True:
        left = None if budget is None else budget - out.spent
        if left is not None and left <= 0:
            return out
        credit = balance()
        if credit == 0 and first:
            raise CreditsExhausted()
        limit = min(x for x in (PAGE, left, credit or None) if x is not None)
        try:
            records, more = page(start + len(out.records), limit)
        except CreditsExhausted as e:
            out.truncated += e.required
            out.error = "credits exhausted"
            return out
        except Exception as e:
            if first:
                raise
            out.error = str(e)
            return out
        out.records += records
        out.spent += len(records)
        out.truncated = max(out.truncated, more)
        first = False
        if len(records) < limit:
            return out
