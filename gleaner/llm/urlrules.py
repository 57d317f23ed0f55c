"""URL filtering by association rules.

Explicit rules (host, path) decide the urls that they fit. These urls are also the labels from which
FP-growth mines combinations of url tokens (host suffixes, path words, query keys) that imply
`block` or `allow`; rules are pruned by support and confidence, and those that add a token without gaining
confidence are dropped. A join on each rule's rarest token finds the rules that a url meets;
of these the most confident decides the urls that no explicit rule fits; without one they are allowed.

Patterns grow as in FP-growth, from the rarest token to more frequent ones, each in the urls that hold it (its conditional
table), but a level at a time, so that the tables of all patterns of a level are one DataFrame that Spark shuffles. All
tokens of a url take part. Three exact cuts keep the patterns few: tokens that occur in the same urls are one item; a set that
occurs as often as a part of it says nothing new, and neither does any set around it; a set whose urls all
have one verdict can't gain confidence. Sets, rules and matches are tables in the shared folder, whatever their number; to
the driver come the frequent items alone. The time follows the number of sets that are frequent, mixed and rarer than each of
their parts: nested tokens (suffixes of a host, steps of a path) add one each, tokens that are independent of each other
and of the verdict multiply until support ends them.

Defined cases: null urls and urls without `://` have empty host and path, no rule, and are allowed; an empty
host fits no rule; no labelled url gives no mined rule; repeated rows give a row each; an empty table gives an
empty result. Runs of digits in tokens become `#`, as numbers of pages carry no meaning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, settle, ship

#: The explicit rules, (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
SUPPORT, CONFIDENCE = 0.005, 0.8
#: Items of a url that can stand in mined rules: all.
TOKENS = None


def host_of(url):
    rest = F.expr("substring(_url, locate('://', _url) + 3)")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.expr("locate('://', _url) > 0"), lower).otherwise("")


def path_of(url):
    rest = F.expr("substring(_url, locate('://', _url) + 3)")
    return F.when(F.expr("locate('://', _url) > 0"), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def parse(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path and query."""
    rows = pages.withColumn("_url", F.coalesce(F.col(url).cast("string"), F.lit("")))
    return rows.withColumns({"host": host_of(url), "path": path_of(url), "_query": F.regexp_extract("_url", r"(?s)^[^?#]*\?([^#]*)", 1)}).drop("_url")


def decide(rows: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """rows with `rule` and `ruled`: the longest rule (host, then path) that fits, and its verdict."""
    rule = ruled = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, ruled = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return rows.withColumns({"rule": rule, "ruled": ruled})


def tokens(host, path, query):
    """Distinct tokens: each suffix of the host, words of the path with their places, query keys."""
    number = lambda c: F.regexp_replace(c, "[0-9]+", "#")
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    words = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), number(x)))
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key:"), number(F.substring_index(x, "=", 1))))
    return F.array_distinct(F.concat(F.when(host == "", F.array().cast("array<string>")).otherwise(suffixes), words, keys))


def items_of(labelled: DataFrame, support: float = SUPPORT) -> tuple[dict[str, str], dict[str, int]]:
    """token -> item, for frequent tokens, and item -> how often it occurs, from rows (items, verdict).

    To the driver come tokens of at least `support` of the rows, so no more than a url has tokens, divided by `support`.
    """
    rows = labelled.select("items", (F.col("verdict") == "block").cast("int").alias("block"))
    n = rows.count()
    if not n:
        return {}, {}
    # tokens of the same urls have the same sums of two hashes of their urls' items, which stand for the rows
    one = lambda seed: F.sum(F.xxhash64(F.lit(seed), "items").cast("decimal(38,0)"))
    each = rows.select(F.explode(F.array_distinct("items")).alias("token"), "items", "block").groupBy("token").agg(F.count("*").alias("n"), F.sum("block").alias("block"), one(1).alias("a"), one(2).alias("b"))
    found = sorted(each.where(F.col("n") >= support * n).collect(), key=lambda r: r.token)
    same: dict[tuple, str] = {}
    item = {r.token: same.setdefault((r.n, r.block, r.a, r.b), r.token) for r in found}
    return item, {r.token: r.n for r in found if item[r.token] == r.token}


def ordered(often: dict[str, int]) -> list[str]:
    """Items, the rarest first."""
    return sorted(often, key=lambda t: (often[t], t))


def baskets(items: Column, item: dict[str, str], order: list[str]) -> Column:
    """A url's items as their places in `order`, ascending; null for none."""
    if not order:
        return F.lit(None).cast("array<int>")
    rank = {t: i for i, t in enumerate(order)}
    at = F.create_map(*(F.lit(x) for t, i in item.items() for x in (t, rank[i])))
    found = F.array_sort(F.array_distinct(F.array_compact(F.transform(items, lambda t: F.try_element_at(at, t)))))
    return F.when(F.size(found) > 0, found)


def grow(labelled: DataFrame, order: list[str], support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(lead, set, items, verdict, n, confidence): all rules of rows (basket, verdict), but those of which a part says as much; settled.

    set: places in `order`, lead the first of them; n: the rows with the set and the verdict.
    """
    block = F.sum((F.col("verdict") == "block").cast("long"))
    held = settle(labelled.groupBy("basket").agg(F.count("*").alias("n"), block.alias("block")))
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least, none = support * total, F.array().cast("array<int>")
    # a pattern with those of its rows' items that it can grow by; rows that agree in them are one
    table = held.where("basket is not null").select(none.alias("set"), F.col("basket").alias("rest"), "n", "block")
    live = labelled.sparkSession.range(1).select(none.alias("set"), F.lit(total + 1).alias("n"), *(F.lit(-1.0).alias(c) for c in ("block_by_part", "allow_by_part")))
    levels, size = [], 0
    while True:
        size += 1
        grown = table.select("set", F.explode("rest").alias("x"), "n", "block").groupBy("set", "x").agg(F.sum("n").alias("n"), F.sum("block").alias("block"))
        sets = grown.where(F.greatest("block", F.col("n") - F.col("block")) >= least).select(F.array_append("set", F.col("x")).alias("set"), "n", "block")
        parts = F.array(*(F.concat(F.slice("set", 1, i), F.slice("set", i + 2, size)) for i in range(size)))
        known = sets.withColumn("part", F.explode(parts)).join(live.select(F.col("set").alias("part"), F.col("n").alias("of"), "block_by_part", "allow_by_part"), "part")
        known = known.groupBy("set", "n", "block").agg(F.count("*").alias("parts"), F.min("of").alias("of"), F.max("block_by_part").alias("block_by_part"), F.max("allow_by_part").alias("allow_by_part"))
        found = settle(known.where((F.col("parts") == size) & (F.col("n") < F.col("of"))).drop("parts", "of"))
        levels.append(found)
        sure = lambda verdict, hits: F.greatest(f"{verdict}_by_part", hits / F.col("n")).alias(f"{verdict}_by_part")
        live = found.where("block > 0 and block < n").select("set", "n", sure("block", F.col("block")), sure("allow", F.col("n") - F.col("block")))
        if not live.limit(1).count():
            break
        by = live.groupBy(F.slice("set", 1, size - 1).alias("set")).agg(F.collect_list(F.element_at("set", -1)).alias("by"))  # as many as there are items at most
        rows = table.join(F.broadcast(by) if size == 1 else by, "set").select("set", F.array_sort(F.array_intersect("rest", "by")).alias("rest"), "n", "block")
        rows = rows.select("set", "rest", F.posexplode("rest").alias("at", "x"), "n", "block").select(F.array_append("set", F.col("x")).alias("set"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"), "n", "block")
        table = settle(rows.where(F.size("rest") > 0).groupBy("set", "rest").agg(F.sum("n").alias("n"), F.sum("block").alias("block")))
    says = lambda verdict, hits: F.struct(F.lit(verdict).alias("verdict"), hits.alias("hits"), F.col(f"{verdict}_by_part").alias("part"))
    each = reduce(DataFrame.union, levels).select("set", "n", F.inline(F.array(says("block", F.col("block")), says("allow", F.col("n") - F.col("block")))))
    each = each.withColumn("confidence", F.col("hits") / F.col("n")).where((F.col("hits") >= least) & (F.col("confidence") >= confidence) & (F.col("confidence") > F.col("part")))
    names = F.array(*(F.lit(t) for t in order)) if order else F.array().cast("array<string>")
    items = F.array_sort(F.transform("set", lambda i: F.element_at(names, i + 1)))
    return settle(each.select(F.element_at("set", 1).alias("lead"), "set", items.alias("items"), "verdict", F.col("hits").alias("n"), "confidence"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> list[tuple[tuple[str, ...], str, float, float]]:
    """(items, verdict, confidence, support), best first, from rows (items, verdict); a list of all rules, for a look at them."""
    n = labelled.count()
    item, often = items_of(labelled, support)
    order = ordered(often)
    rules = grow(labelled.select(baskets(F.col("items"), item, order).alias("basket"), "verdict"), order, support, confidence).collect()
    return sorted(((tuple(r["items"]), r.verdict, r.confidence, r.n / n) for r in rules), key=lambda r: (-r[2], -r[3], r[0], r[1]))


def best_rules(baskets: DataFrame, rules: DataFrame) -> DataFrame:
    """(basket, times, found) for each basket that is not null; found: verdict and confidence of the best rule that it has all items of, or nulls."""
    own = settle(baskets.where("basket is not null").groupBy("basket").agg(F.count("*").alias("times")))
    met = own.select("basket", F.explode("basket").alias("lead")).join(rules, "lead").where(F.size(F.array_except("set", "basket")) == 0)
    best = met.groupBy("basket").agg(F.min(F.struct((-F.col("confidence")).alias("confidence"), (-F.col("n")).alias("n"), "items", "verdict")).alias("best"))
    return settle(own.join(best, "basket", "left").select("basket", "times", F.struct(F.col("best.verdict").alias("mined"), (-F.col("best.confidence")).alias("confidence")).alias("found")))


class Index:
    """Rules by their rarest token, for single urls; tables of them are joined with the rules."""

    def __init__(self, rules: list[tuple[tuple[str, ...], str, float, float]]):
        often: dict[str, int] = {}
        for items, *_ in rules:
            for t in items:
                often[t] = often.get(t, 0) + 1
        self.at: dict[str, list] = {}
        for rank, (items, verdict, conf, _) in enumerate(rules):
            self.at.setdefault(min(items, key=lambda t: (often[t], t)), []).append((rank, frozenset(items), verdict, conf))

    def match(self, items) -> tuple[str, float] | None:
        """Verdict and confidence of the best rule whose tokens are all there."""
        own = set(items)
        best = min((r for t in own for r in self.at.get(t, ()) if r[1] <= own), key=lambda r: r[0], default=None)
        return best and (best[2], best[3])


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(key, host, path, rule, verdict, mined, confidence) for each row."""
    spark = pages.sparkSession
    ship(spark)
    rows = decide(parse(pages.select(F.col(key).cast("long").alias(key), F.col(url).alias("_source")), "_source"), rules)
    rows = rows.withColumn("items", tokens(F.col("host"), F.col("path"), F.col("_query"))).drop("_source", "_query")
    labelled = rows.where("ruled is not null and size(items) > 0").select("items", F.col("ruled").alias("verdict"))
    item, often = items_of(labelled, support)
    order = ordered(often)
    rows = rows.withColumn("basket", baskets(F.col("items"), item, order))
    mined = grow(rows.where("ruled is not null and size(items) > 0").select("basket", F.col("ruled").alias("verdict")), order, support, confidence)
    found = looked_up(rows.drop("items"), "basket", best_rules(rows, mined), "found", "times")
    return found.select(key, "host", "path", "rule", F.coalesce("ruled", "found.mined", F.lit("allow")).alias("verdict"), F.col("found.mined").alias("mined"), F.col("found.confidence").alias("confidence"))
