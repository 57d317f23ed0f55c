"""The log as segments, the book that follows it, and ingestion as a stream: against whole folds and against one batch."""

import datetime as dt
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.operators import book, ingest, run, triage, views
from gleaner.sources import commits, eventlog, segments
from gleaner.streaming import ingest as ingest_stream

EVENT = eventlog.SCHEMA


def made(spark, rows):
    """Events of (stream, seq, type, payload) in order."""
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, 1, f"{s}-{n}-{i}", s, n, t, 1, at + dt.timedelta(seconds=p.pop("_at", i)), at + dt.timedelta(seconds=i), None, "c", json.dumps(p)) for i, (s, n, t, p) in enumerate(rows)], EVENT)


def scored(stream, n):
    return (stream, n, "scored", {"composite": n, "revision": 1})


def test_append_read_and_prune(spark, tmp_path):
    root = str(tmp_path)
    assert segments.last(spark, root) == 0 and segments.read(spark, root).count() == 0
    assert segments.append(made(spark, [scored("lead/a", 1), scored("lead/b", 1)] * 50), root) == 1
    assert segments.append(made(spark, [scored("lead/c", 2), ("discovery/x", 1, "discovery", {})]), root) == 2
    assert segments.append(made(spark, [scored("lead/a", 9)]), root, as_of=2) == 3
    rows = segments.read(spark, root).orderBy("ordinal").collect()
    assert [r.stream for r in rows] == ["lead/a", "lead/b"] * 50 + ["lead/c", "discovery/x", "lead/a"] and [r.ordinal >> 40 for r in rows] == [1] * 100 + [2, 2, 3]
    assert [r.n for r in segments.segments(spark, root, stream="lead/a").orderBy("n").collect()] == [1, 3]
    assert [r.n for r in segments.segments(spark, root, types=["discovery"]).collect()] == [2]
    one = segments.read(spark, root, stream="lead/a")
    assert one.count() == 51 and len(one.inputFiles()) < len(segments.read(spark, root).inputFiles())
    assert "EqualTo(stream,lead/a)" in one._jdf.queryExecution().toString()
    assert segments.read(spark, root, since=2, until=2).count() == 2 and segments.read(spark, root, types=["discovery"]).count() == 1
    assert segments.append(made(spark, []), root) == 3


def test_a_filter_never_loses_a_stream(spark, tmp_path):
    root = str(tmp_path)
    names = [f"lead/{i * 7919}" for i in range(3000)]
    segments.append(made(spark, [scored(s, 1) for s in names]), root)
    probe = spark.createDataFrame([(s,) for s in names], "s string")
    bits = spark.read.schema(segments._RECORD).json(f"{root}/commits")
    has = [segments._has_bit(p) for p in segments._places(F.col("s"), F.col("bits"))]
    assert probe.crossJoin(bits).where(has[0] & has[1] & has[2]).count() == len(names)
    assert probe.withColumn("s", F.concat("s", F.lit("x"))).crossJoin(bits).where(has[0] & has[1] & has[2]).count() < 150


def test_two_writers(spark, tmp_path):
    root = str(tmp_path)
    segments.append(made(spark, [scored("lead/a", 1)]), root)
    segments.append(made(spark, [scored("lead/a", 2)]), root, as_of=1)
    with pytest.raises(segments.Conflict, match="since segment 1"):
        segments.append(made(spark, [scored("lead/a", 2)]), root, as_of=1)
    with pytest.raises(segments.Conflict, match="the log has been written to since segment 1"):
        segments.append(made(spark, [scored("lead/b", 1)]), root, as_of=1, whole=True)
    assert segments.append(made(spark, [scored("lead/b", 1)]), root, as_of=1) == 3  # another stream
    with pytest.raises(commits.Conflict):
        commits.create(spark, f"{root}/commits", 3, {})
    assert not [f for f in (tmp_path / "commits").iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]


def test_a_writer_that_loses_its_number_goes_behind(spark, tmp_path, monkeypatch):
    root, create = str(tmp_path), commits.create

    def overtaken(spark_, folder, n, what):
        monkeypatch.setattr(commits, "create", create)
        segments.append(made(spark_, [scored("lead/z", 1)]), root)
        return create(spark_, folder, n, what)

    monkeypatch.setattr(commits, "create", overtaken)
    assert segments.append(made(spark, [scored("lead/a", 1), scored("lead/a", 2)]), root, as_of=0) == 2
    assert [(r.stream, r.ordinal >> 40) for r in segments.read(spark, root).orderBy("ordinal").collect()] == [("lead/z", 1), ("lead/a", 2), ("lead/a", 2)]


def test_a_batch_that_fails_is_not_there(spark, tmp_path):
    root = str(tmp_path)
    segments.append(made(spark, [scored("lead/a", 1)]), root)
    bad = made(spark, [scored("lead/a", i) for i in range(40)]).withColumn("payload", F.when(F.col("seq") == 39, F.raise_error(F.lit("half way")).cast("string")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="half way"):
        segments.append(bad, root)
    assert segments.last(spark, root) == 1 and segments.read(spark, root).count() == 1


def test_repetitions_are_written_once(spark, tmp_path):
    root = str(tmp_path)
    batch = made(spark, [scored("lead/a", 1)])
    assert [segments.append(batch, root, txn=("q", 0)), segments.append(batch, root, txn=("q", 0)), segments.append(batch, root, txn=("r", 0)), segments.append(made(spark, []), root, txn=("q", 1))] == [1, 1, 2, 3]
    assert segments.done(spark, root, "q") == 1 and segments.done(spark, root, "none") == -1 and segments.read(spark, root).count() == 2


def test_lines_and_segments(spark, tmp_path):
    log, root = str(tmp_path / "log.jsonl"), str(tmp_path / "log")
    events = [{"envelope_version": 1, "id": f"e{i}", "stream": "lead/a", "seq": i, "type": "scored", "schema_version": 1, "occurred_at": "2024-01-01T00:00:00Z", "recorded_at": "2024-01-01T00:00:01.5Z", "correlation_id": "c", "payload": {"composite": i}} for i in range(1, 30)]
    eventlog.append(log, events, {})
    assert segments.load_lines(spark, log, root, step=1500) > 2
    segments.save_lines(segments.read(spark, root), str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted((e["seq"], e["id"], e["payload"]["composite"], "causation_id" in e) for e in lines) == [(i, f"e{i}", i, False) for i in range(1, 30)]
    assert {dt.datetime.fromisoformat(e["recorded_at"]) for e in lines} == {dt.datetime(2024, 1, 1, 0, 0, 1, 500_000, tzinfo=dt.UTC)}


def random_log(seed, n):
    g, seq, out = random.Random(seed), Counter(), []
    for i in range(n):
        lead = f"lead/{g.randrange(12)}"
        seq[lead] += 1
        kind = g.choice(["ingested", "updated", "edited", "scored", "rejected", "reviewed", "apply_queued", "applied", "archived", "reingest_suppressed"])
        snapshot = {"dedupe_key": f"k{g.randrange(9)}", "identifiers": {"req": f"r{g.randrange(9)}"}, "adapter": "x", "url": "u", "raw_text": f"t{i}", "extracted": {"title": f"T{i}"}}
        payload = {"scored": {"composite": i, "revision": g.randrange(6), "breakdown": f"b{i}"}, "rejected": {"gate": f"g{i}", "reason": "y", "revision": g.randrange(6)}, "reviewed": {"mark": g.choice(["defer", "ignore", "apply-manual"])}, "applied": {"method": f"m{i}", "note": "n"}, "archived": {"note": None}, "apply_queued": {}, "reingest_suppressed": {"dedupe_key": f"k{g.randrange(9)}"}}.get(kind, snapshot)
        out.append((lead, seq[lead], kind, payload | {"_at": g.randrange(50)}))
    return out


@pytest.mark.parametrize("cuts", [[0, 300], [0, 1, 40, 41, 150, 300], [0, 30, 60, 90, 120, 150, 180, 210, 240, 270, 300]])
def test_book_follows_the_log(spark, tmp_path, cuts, monkeypatch):
    root, log, read = str(tmp_path), random_log(len(cuts), 300), []
    monkeypatch.setattr(book, "MOST_RUNS", 4)
    real = segments.read
    for a, b in zip(cuts, cuts[1:], strict=False):
        segments.append(made(spark, [(s, n, t, dict(p)) for s, n, t, p in log[a:b]]), root)
        monkeypatch.setattr(segments, "read", lambda s, r, since=1, until=None, *x: read.append((since, until)) or real(s, r, since, until, *x))
        kept = book.Book(spark, root).update()
        monkeypatch.setattr(segments, "read", real)
    assert [r for r in read if r != (1, 0)] == [(i, i) for i in range(1, len(cuts))]  # a segment is read once, by the update that follows it
    assert kept.until == len(cuts) - 1 and len(kept.runs) <= 4 and kept.update() is kept
    whole = views.typed(segments.read(spark, root)).where("lead_id is not null")
    rows = lambda df: Counter(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(book.lead_record(kept.leads())) == rows(views.lead_record(whole))
    assert rows(book.aggregate_state(kept.leads())) == rows(views.aggregate_state(whole))
    assert rows(book.index(kept.forms())) == rows(views.index_of(whole))


def test_two_updates_at_once(spark, tmp_path):
    root = str(tmp_path)
    segments.append(made(spark, [(s, n, t, dict(p)) for s, n, t, p in random_log(1, 80)]), root)
    a, b = book.Book(spark, root), book.Book(spark, root)
    a.update()
    assert b.update().runs == book.Book(spark, root).runs and len(book.Book(spark, root).runs) == 1


CONFIG = triage.Config(remote_only=True, floor=100_000, blacklist=("Evil Inc",))


def postings(n):
    g, out = random.Random(9), []
    for i in range(n):
        c = g.choice(["Acme", "Beta", "Evil Inc"])
        out.append((i, g.choice(["Dev", "Ops", "Lead"]), c, g.choice([None, f"R-{g.randrange(6)}"]), None, g.choice([True, None, False]), None, f"text {g.randrange(4)}", g.choice([None, f"https://ex.com/{g.randrange(8)}"]), "feed", "s"))
    return out


POSTING = f"pos long, {run.POSTING}, source string"


def outcome(spark, root):
    """The log in words that don't depend on ids: leads are named in the order in which they came."""
    names, out = {}, []
    for r in segments.read(spark, root).orderBy("ordinal").collect():
        p = json.loads(r.payload)
        out.append((names.setdefault(r.stream, len(names)), r.seq, r.type, p.get("revision"), tuple(p.get("changed") or ()), p.get("gate"), p.get("composite"), p.get("raw_text")))
    return out


def test_ingest_as_a_stream(spark, tmp_path):
    rows = postings(60)
    whole, split = str(tmp_path / "whole"), str(tmp_path / "split")
    ingest_stream.decide_batch(spark.createDataFrame(rows, POSTING), 0, whole, CONFIG, "one", "2024-01-01T00:00:00Z")
    want = outcome(spark, whole)
    assert {x[2] for x in want} >= {"ingested", "updated", "scored", "rejected"} and max(x[3] or 0 for x in want) > 3
    source, begun = str(tmp_path / "in"), False
    for a, b in ((0, 7), (7, 8), (8, 40), (40, 60)):
        spark.createDataFrame(rows[a:b], POSTING).coalesce(1).write.mode("append").parquet(source)
        # each start goes on from the checkpoint
        q = ingest_stream.start(spark.readStream.schema(POSTING).parquet(source), split, CONFIG, str(tmp_path / "checkpoint"), now="2024-01-01T00:00:00Z")
        q.awaitTermination(300)
        assert q.exception() is None and (begun := True)
    assert begun and outcome(spark, split) == want
    # a batch that is run again after its commit changes nothing
    n = segments.last(spark, split)
    assert ingest_stream.decide_batch(spark.createDataFrame(rows[40:60], POSTING), 3, split, CONFIG, "ingest", "2024-01-01T00:00:00Z") == n
    assert ingest.ingest is not None and outcome(spark, split) == want
