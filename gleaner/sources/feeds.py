"""A paid search feed as a table: records as JSON, one row each, with a lower bound of their time pushed into the request.

A filter discovered_at >= x becomes the request's own bound (records at the bound come again: identity tells them); one
that the feed can't serve stays with Spark. Pages are asked for one after the other, by one task, within the budget,
as each record costs. The transport is a class attribute, so that it travels with the source:
register(spark, post) makes it known, post(query) -> dict.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

from ..operators.discovery import fetch_within_budget

SCHEMA = "position long, discovered_at string, record string"


class _Reader(DataSourceReader):
    def __init__(self, options, post: Callable[[dict], dict], balance: Callable[[], int | None]):
        self.query, self.post, self.balance = json.loads(options.get("query", "{}")), post, balance
        self.budget = int(options["budget"]) if "budget" in options else None

    def pushFilters(self, filters: list[Filter]):
        """Bounds on discovered_at go into the request; a bound that excludes its own value is still Spark's to check."""
        for f in filters:
            if isinstance(f, GreaterThanOrEqual | GreaterThan) and f.attribute == ("discovered_at",) and isinstance(f.value, str):
                self.query["discovered_at_gte"] = max(f.value, self.query.get("discovered_at_gte", ""))
                if isinstance(f, GreaterThanOrEqual):
                    continue
            yield f

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        def page(offset: int, limit: int):
            answer = self.post(self.query | {"offset": offset, "limit": limit})
            return answer["data"], int((answer.get("metadata") or {}).get("truncated_results") or 0)

        least = self.query.get("discovered_at_gte")
        for i, r in enumerate(fetch_within_budget(page, self.balance, self.budget).records):
            at = r.get("discovered_at")
            if least is None or (at is not None and at >= least):  # what the feed was asked for holds of every row
                yield i, at, json.dumps(r, separators=(",", ":"), ensure_ascii=False)


def register(spark: SparkSession, post: Callable[[dict], dict], balance: Callable[[], int | None] = lambda: None) -> None:
    """Make format("paidfeed") known; options: query (JSON), budget (records)."""

    class PaidFeed(DataSource):
        @classmethod
        def name(cls):
            return "paidfeed"

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return _Reader(self.options, post, balance)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PaidFeed)
