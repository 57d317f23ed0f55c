"""Gates, scores and identities of postings, as projections over their columns.

A posting has: title, company, req_id, location, remote, comp struct<min, max>, url, raw_text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extraction import level
from ..functions.text import canonical_url, java_quote, let, normalize_req, normalize_text, prefix_bytes, sha256, slugify, token_in, weight_text


@dataclass(frozen=True)
class Config:
    """Side inputs: small, fixed for a run, and compiled into the plan."""

    floor: int | None = None
    ceiling: int | None = None
    multiplier: float | None = None
    remote_only: bool = True
    reject_location_only: bool = False
    blacklist: tuple[str, ...] = ()
    red_lines: tuple[str, ...] = ()
    skills: tuple[str, ...] | None = None
    aliases: dict[str, str] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(("level", "skills", "compensation", "remote"), 1.0))

    @property
    def cap(self) -> int | None:
        return None if self.ceiling is None or self.multiplier is None else int(self.ceiling * self.multiplier + 0.5)


def compared_value(comp: Column) -> Column:
    """The larger end of a range, in whatever order its ends stand."""
    low, high = comp["min"], comp["max"]
    return F.when(low.isNotNull() & high.isNotNull(), F.greatest(low, high)).otherwise(F.coalesce(high, low))


def _failure(when: Column, gate: str, reason: Column) -> Column:
    return F.when(when, F.struct(F.lit(gate).alias("gate"), reason.alias("reason")))


def company_matches(company: Column, entry: Column) -> Column:
    """Equal without blanks and dashes, or all words of the entry among the company's."""
    a, b = slugify(company), slugify(entry)
    return (b != "") & ((F.replace(a, F.lit("-"), F.lit("")) == F.replace(b, F.lit("-"), F.lit(""))) | (F.size(F.array_except(F.split(b, "-"), F.split(a, "-"))) == 0))


def gate_failures(c: Config) -> Column:
    """array<struct<gate, reason>>: all failures, in fixed order; empty if the posting passes."""
    # Names of gates and the wording of their reasons.
    out, location, remote = [], F.col("location"), F.col("remote")
    if c.remote_only:
        out.append(_failure(remote.eqNullSafe(False), "remote-only", F.concat(F.lit("confident non-remote signals (location: "), F.coalesce(location, F.lit("none")), F.lit(")"))))
        if c.reject_location_only:
            out.append(_failure(remote.isNull() & location.isNotNull(), "remote-only", F.concat(F.lit("location '"), location, F.lit("' listed with no remote signal (reject_location_only)"))))
    if c.floor is not None:
        quoted = compared_value(F.col("comp"))
        out.append(_failure(quoted < c.floor, "compensation-floor", F.concat(F.lit("quoted max $"), quoted.cast("string"), F.lit(f" below floor ${c.floor}"))))
    for entry in c.blacklist:
        out.append(_failure(F.coalesce(company_matches(F.col("company"), F.lit(entry)), F.lit(False)), "blacklist", F.concat(F.lit("company '"), F.col("company"), F.lit(f"' matches blacklist entry '{entry}'"))))
    for line in c.red_lines:
        if line:
            # the match and what follows it, up to the character that holds its 40th byte
            parts = r"(?isu)(" + java_quote(line) + r")(.{0,40})"
            found = F.struct(*(F.regexp_extract(F.col("raw_text"), parts, i).alias(n) for i, n in ((1, "line"), (2, "after"))))
            said = let(found, lambda m: F.when(m["line"] != "", F.concat(F.lit(f"posting matches red line '{line}': …"), m["line"], prefix_bytes(m["after"], F.lit(40)), F.lit("…"))))
            out.append(let(said, lambda reason: _failure(reason.isNotNull(), "ideological", reason)))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<struct<gate:string,reason:string>>")


def skills_score(text: Column, c: Config) -> Column:
    """Ten points for each keyword that the text has, a hundred at most."""
    hits = F.lit(0)
    for keyword in c.skills or ():
        k = keyword.lower()
        if "(" in k:
            head, _, inner = k.partition("(")
            found = token_in(head.strip(), text)
            for x in inner.rstrip(")").split(","):
                found = found | token_in(x.strip(), text)
        else:
            parts = k.split()
            found = F.lit(bool(parts))
            for x in parts:
                found = found & token_in(x, text)
            for alias, target in c.aliases.items():
                if target.lower() == k:
                    found = found | token_in(alias.lower(), text)
        hits = hits + found.cast("int")
    return (F.least(hits, F.lit(10)) * 10).cast("long")


def compensation(c: Config) -> Column:
    """struct(kind, value, score): unknown, implausible or scored."""
    value = compared_value(F.col("comp"))
    make = lambda kind, score: F.struct(F.lit(kind).alias("kind"), value.alias("value"), score.cast("long").alias("score"))
    none = make("unknown", F.lit(None))
    if c.floor is None or c.ceiling is None:
        return none
    out = F.when(value.isNull(), none)
    if c.cap is not None:
        out = out.when(value > c.cap, make("implausible", F.lit(None)))
    if c.ceiling <= c.floor:
        return out.otherwise(none)
    share = F.greatest(value - c.floor, F.lit(0)) / F.lit(float(c.ceiling - c.floor)) * 100
    return out.otherwise(make("scored", F.round(F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0)))))


def with_score(df: DataFrame, c: Config) -> DataFrame:
    """df with dimensions (level, skills, compensation, remote; unknown ones dropped), composite and breakdown."""
    text = F.concat_ws("\n", "title", "raw_text")
    df = df.withColumn("_comp", compensation(c))
    scores = {"level": level("title", "raw_text"), "skills": F.lit(None).cast("long") if not c.skills else skills_score(text, c), "compensation": F.col("_comp.score"), "remote": F.when(F.col("remote"), 100).when(F.col("remote").isNull(), 50).otherwise(0).cast("long")}
    one = [F.struct(F.lit(n).alias("name"), s.alias("score"), F.lit(float(c.weights.get(n, 1.0))).alias("weight"), F.lit(1.0).alias("confidence")) for n, s in scores.items()]
    df = df.withColumn("dimensions", F.filter(F.array(*one), lambda d: d["score"].isNotNull()))
    d = F.col("dimensions")
    total = F.aggregate(d, F.lit(0.0), lambda a, x: a + x["weight"])
    df = df.withColumn("composite", F.when(total > 0, F.round(F.aggregate(d, F.lit(0.0), lambda a, x: a + x["weight"] * x["score"]) / total)).otherwise(0).cast("long"))
    # The wording of a breakdown and its notes.
    parts = F.array_join(F.transform(d, lambda x: F.concat(weight_text(F.when(total > 0, x["weight"] / total).otherwise(0.0)), F.lit("·"), x["name"], F.lit("("), x["score"].cast("string"), F.lit(")"))), " + ")
    implausible = F.concat(F.lit("compensation: implausible ("), F.col("_comp.value").cast("string"), F.lit(f" exceeds cap {c.cap}), weight renormalized"))
    notes = F.array_join(F.array_compact(F.array(F.lit("skills: no resume, weight renormalized") if not c.skills else F.lit(None), F.when(F.col("_comp.kind") == "unknown", "compensation: unknown, weight renormalized").when(F.col("_comp.kind") == "implausible", implausible))), "; ")
    return df.withColumn("breakdown", F.concat(F.col("composite").cast("string"), F.lit(" = "), parts, F.when(notes != "", F.concat(F.lit(" ["), notes, F.lit("]"))).otherwise(""))).drop("_comp")


def identity() -> Column:
    """struct(dedupe_key, req, url, tc): the first of req, url, tc there is, else a hash of the text."""
    req = F.concat(F.lit("req:"), slugify("company"), F.lit(":"), normalize_req("req_id"))
    url = F.concat(F.lit("url:"), canonical_url("url"))
    tc = F.concat(F.lit("tc:"), sha256(F.concat(normalize_text("title"), F.lit("\n"), normalize_text("company"))))
    forms = F.struct(req.alias("req"), url.alias("url"), tc.alias("tc"))
    return let(forms, lambda x: F.struct(F.coalesce(x["req"], x["url"], x["tc"], F.concat(F.lit("raw:"), sha256("raw_text"))).alias("dedupe_key"), x["req"].alias("req"), x["url"].alias("url"), x["tc"].alias("tc")))


FIELDS = ["title", "company", "req_id", "location", "remote", "comp", "raw_text", "url"]


def changed(old: str, new: str) -> Column:
    """Names of the fields that differ, in fixed order; null equals null."""
    return F.array_compact(F.array(*(F.when(~F.col(f"{old}.{f}").eqNullSafe(F.col(f"{new}.{f}")), F.lit(f)) for f in FIELDS)))


def lookup(postings: DataFrame, index: DataFrame) -> DataFrame:
    """postings (with struct `identity`) and the lead that they match: by req, else url, else tc where neither
    req nor url is known, else the dedupe key. Equi-joins of sorted sides, split if skewed; the index grows with the log, so none is broadcast."""
    i = F.col("identity")
    keys = {"_by_req": i["req"], "_by_url": i["url"], "_by_tc": F.when(i["req"].isNull() & i["url"].isNull(), i["tc"]), "_by_key": i["dedupe_key"]}
    out = postings
    for name, key in keys.items():
        out = out.join(index.select(F.col("form").alias("_form"), F.col("lead_id").alias(name)).hint("merge"), key == F.col("_form"), "left").drop("_form")
    return out.withColumn("matched_lead", F.coalesce(*keys)).drop(*keys)


def forms() -> Column:
    """All forms of a row's identity that there are."""
    i = F.col("identity")
    return F.array_distinct(F.array_compact(F.array(i["req"], i["url"], i["tc"], i["dedupe_key"])))


def collisions(rows: DataFrame, index: DataFrame) -> DataFrame:
    """(lead_id, owner, form): of rows (lead_id, identity) those of whose identifiers another lead owns; the least owner."""
    asked = rows.select("lead_id", F.explode(forms()).alias("form")).join(index.select("form", F.col("lead_id").alias("owner")), "form")
    other = asked.where(~F.col("owner").cast("string").eqNullSafe(F.col("lead_id").cast("string")))
    return other.groupBy("lead_id").agg(F.min(F.struct("owner", "form")).alias("o")).select("lead_id", "o.owner", "o.form")
