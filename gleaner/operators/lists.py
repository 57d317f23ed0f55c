"""Gates over long lists: a blacklist and red lines of many thousands of entries, with the reasons and the order that triage gives.

A blacklist is a table. Of each entry one token is looked up, the one that the fewest companies have: an equi-join on it
finds all companies that could hold the entry's tokens, which are then compared. Companies are met once each, however
many postings they have. Red lines are found together in one pass over a text by an automaton (Aho and Corasick) of the
folded lines, built once in each worker; characters are folded one by one, so places stay those of the text.
Lines beyond what a worker can hold are a table: of each line the run of GRAM characters (or the whole line, if it is
shorter) that the fewest texts have is looked up among the texts' own runs, and texts found are searched for the line.

Defined cases: an entry without a letter or digit and an empty line match nothing; null companies and texts pass;
repeated entries and lines give a failure each; empty lists give none.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.text import prefix_bytes, slugify
from ..sources.shared import keep
from .triage import Config, gate_failures

#: Bytes of red lines: they travel with the tasks, and their automaton is held by each worker.
LINE_BYTES = 8 << 20
#: Characters of a line by which it is looked up in a table.
GRAM = 8
#: Bits of the filter that texts' runs pass before they are dealt: a number of bits for each line, so many (8 MB) at most.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26

_FAILURES = "array<struct<gate:string,reason:string>>"


def _tokens(slug: Column) -> Column:
    return F.filter(F.split(slug, "-"), lambda x: x != "")


def blacklisted(companies: DataFrame, entries: DataFrame) -> DataFrame:
    """(company, at, entry) of companies (company) and entries (at, entry) that match as triage.company_matches() has it."""
    names = companies.where("company is not null").select("company").distinct().withColumn("_a", slugify("company"))
    listed = entries.select("at", "entry").withColumn("_b", slugify("entry")).where("_b <> ''")
    joined = lambda c: F.replace(F.col(c), F.lit("-"), F.lit(""))
    same = names.withColumn("_k", joined("_a")).join(listed.withColumn("_k", joined("_b")), "_k").select("company", "at", "entry")
    held = names.select("company", "_a", F.explode(F.array_distinct(_tokens(F.col("_a")))).alias("token"))
    often = held.groupBy("token").agg(F.count("*").alias("_n"))
    # an entry with a token that no company has matches none by its tokens
    asked = listed.select("at", "entry", "_b", F.explode(F.array_distinct(_tokens(F.col("_b")))).alias("token")).join(often, "token", "left")
    rarest = asked.groupBy("at", "entry", "_b").agg(F.min_by("token", F.struct(F.coalesce("_n", F.lit(0)), "token")).alias("token"))
    whole = held.join(rarest, "token").where(F.size(F.array_except(F.split("_b", "-"), F.split("_a", "-"))) == 0).select("company", "at", "entry")
    return same.union(whole).distinct()


def _simple(c: str) -> str:
    """Lower case of upper case, by one character; Python's own mappings may have several where Unicode also has one."""
    up = next((x for x in (c.upper(), c.title()) if len(x) == 1), c)
    return up.lower()[0]


class _Fold(dict):
    """Code point -> its simple case folding, for str.translate."""

    def __missing__(self, code: int) -> int:
        out = self[code] = ord(_simple(chr(code)))
        return out


_fold = _Fold()


def folded(text: str) -> str:
    """The text with each character folded by itself: of the same length."""
    return text.lower() if text.isascii() else text.translate(_fold)


@functools.lru_cache(maxsize=2)
def _automaton(lines: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, line in enumerate(lines):
        if line:
            key = folded(line)
            found.add_word(key, (*found.get(key, ()), i))
    found.make_automaton()
    return found


def first_places(texts: pd.Series, lines: tuple[str, ...]) -> pd.Series:
    """For each text, (line, where it occurs first) of the lines that it has, in the order of the lines."""
    automaton, out = _automaton(lines), []
    for text in texts:
        first: dict[int, int] = {}
        if text and len(automaton):
            for end, numbers in automaton.iter(folded(text)):
                if numbers[0] not in first:
                    for i in numbers:
                        first[i] = end + 1 - len(lines[i])
        out.append(None if text is None else [(lines[i], at) for i, at in sorted(first.items())])
    return pd.Series(out, dtype=object)


def red_lined(text: str, lines: list[str]) -> Column:
    """array<struct<gate, reason>>: a failure for each line that the text column has."""
    held = tuple(lines)
    if sum(len(x.encode()) for x in held) > LINE_BYTES:
        raise ValueError(f"red lines of more than {LINE_BYTES} bytes: a table of them is for red_lined_by()")

    @F.pandas_udf("array<struct<line string, at int>>")
    def places(texts: pd.Series) -> pd.Series:
        return first_places(texts, held)

    return F.coalesce(F.transform(places(F.col(text)), lambda p: _failure(F.col(text), p["line"], p["at"])), F.array().cast(_FAILURES))


def _failure(text: Column, line: Column, at: Column) -> Column:
    match, after = F.substring(text, at + 1, F.char_length(line)), F.substring(text, at + F.char_length(line) + 1, F.lit(40))
    # The wording, as in triage.
    return F.struct(F.lit("ideological").alias("gate"), F.concat(F.lit("posting matches red line '"), line, F.lit("': …"), match, prefix_bytes(after, F.lit(40)), F.lit("…")).alias("reason"))


def _runs(text: str, sizes: list[int]) -> np.ndarray:
    """Hashes of the distinct runs of so many characters that a folded text has."""
    out = [np.empty(0, np.uint64)]
    for n in sizes:
        for at in range(0, len(text) - n + 1, 1 << 20):
            codes = np.frombuffer(text[at : at + (1 << 20) + n - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            run = np.full(len(codes) - n + 1, n, np.uint64)
            for i in range(n):
                run = (run ^ codes[i : len(run) + i]) * np.uint64(0x9E3779B97F4A7C15)
                run ^= run >> np.uint64(29)
            out.append(np.unique(run))
    return np.unique(np.concatenate(out)).view(np.int64)


def _each(chosen, schema: str, names: list[str]):
    """For mapInArrow over rows (id, text): rows (id, run) of the runs that `chosen` gives of a text."""

    def run(batches):
        for batch in batches:
            ids, runs, size = [], [], 0
            for i, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = chosen(folded(x))
                ids.append(np.full(len(found), i, np.int64))
                runs.append(found)
                size += len(found)
                if size > 1_000_000:
                    yield pa.record_batch([pa.array(np.concatenate(ids)), pa.array(np.concatenate(runs))], names=names)
                    ids, runs, size = [], [], 0
            if size:
                yield pa.record_batch([pa.array(np.concatenate(ids)), pa.array(np.concatenate(runs))], names=names)

    return run, schema


def _texts_with(sizes: list[int]):
    """For mapInArrow over rows (text): (run, n), in how many texts of a batch each run is."""

    def run(batches):
        for batch in batches:
            held, size = [np.empty(0, np.int64)], 0
            for x in [*batch.column(0).to_pylist(), None]:
                if x is not None:
                    held.append(_runs(folded(x), sizes))
                    size += len(held[-1])
                if size > 1_000_000 or x is None:
                    runs, n = np.unique(np.concatenate(held), return_counts=True)
                    yield pa.record_batch([pa.array(runs), pa.array(n.astype(np.int64))], names=["run", "n"])
                    held, size = [np.empty(0, np.int64)], 0

    return run


@F.pandas_udf(IntegerType())
def _place(texts: pd.Series, lines: pd.Series) -> pd.Series:
    once = functools.lru_cache(maxsize=4)(folded)  # a text's lines come one behind the other
    return pd.Series([once(t).find(folded(x)) for t, x in zip(texts, lines, strict=True)], dtype="int32")


def red_lined_by(texts: DataFrame, lines: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, line, gate, reason): a row for each line (at, line) that a text has, of any number of lines and texts.

    Nothing of the lines but a filter of MOST_BITS passes through the driver. An empty line is in no text.
    """
    spark, none = texts.sparkSession, F.monotonically_increasing_id()
    said = keep(lines.where("line <> ''").select(none.alias("_line"), "at", "line"))
    rows = keep(texts.where(F.col(text).isNotNull()).select(none.alias("_row"), F.col(key), F.col(text).alias("_text")))
    sizes = sorted(r.n for r in said.select(F.least(F.char_length("line"), F.lit(GRAM)).alias("n")).distinct().collect())  # GRAM numbers at most
    often = rows.select("_text").mapInArrow(_texts_with(sizes), "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))
    asked = said.select("_line", "line").mapInArrow(*_each(lambda x: _runs(x, [min(len(x), GRAM)]), "_line long, run long", ["_line", "run"]))
    # a run that no text has comes first, and finds none
    counted = asked.join(often.hint("merge"), "run", "left").groupBy("_line").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0)), "run")).alias("run"))
    rarest = keep(counted)
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * rarest.count()).bit_length()))
    places = rarest.select(F.col("run").bitwiseAND(bits - 1).alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 31 as int)))").alias("b")).toArrow()  # bits / 32 rows at most
    words = np.zeros(bits // 32, np.uint32)
    words[places["w"].to_numpy()] = places["b"].to_numpy()
    shared = spark.sparkContext.broadcast(words)

    def held(x: str) -> np.ndarray:
        runs, words = _runs(x, sizes), shared.value
        at = runs & (len(words) * 32 - 1)
        return runs[(words[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1]

    hits = rows.select("_row", "_text").mapInArrow(*_each(held, "_row long, run long", ["_row", "run"]))
    pairs = hits.join(rarest.hint("merge"), "run").select("_row", "_line").join(said.hint("merge"), "_line").join(rows.hint("merge"), "_row")
    found = pairs.withColumn("_at", _place("_text", "line")).where("_at >= 0")
    return found.select(key, "at", "line", _failure(F.col("_text"), F.col("line"), F.col("_at")).alias("f")).select(key, "at", "line", "f.gate", "f.reason")


def gated(postings: DataFrame, c: Config, entries: DataFrame, lines: list[str]) -> DataFrame:
    """postings with `failures`: triage.gate_failures() of c with these entries (at, entry) as its blacklist and these red lines."""
    found = blacklisted(postings, entries)
    reason = F.concat(F.lit("company '"), F.col("company"), F.lit("' matches blacklist entry '"), F.col("entry"), F.lit("'"))
    by = found.groupBy("company").agg(F.array_sort(F.collect_list(F.struct("at", F.struct(F.lit("blacklist").alias("gate"), reason.alias("reason")).alias("f")))).alias("_black"))
    own = gate_failures(Config(floor=c.floor, remote_only=c.remote_only, reject_location_only=c.reject_location_only))
    black = F.coalesce(F.transform("_black", lambda x: x["f"]), F.array().cast(_FAILURES))
    return postings.join(by, "company", "left").withColumn("failures", F.concat(own, black, red_lined("raw_text", lines))).drop("_black")
