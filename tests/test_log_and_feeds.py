import json
import os

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.operators.discovery import PAGE, CreditsExhausted, fetch_within_budget
from gleaner.sources import eventlog


def event(i, stream="lead/a", **more):
    return {"envelope_version": 1, "id": f"e{i}", "stream": stream, "seq": i, "type": "scored", "schema_version": 1, "occurred_at": "2024-01-01T00:00:00Z", "recorded_at": "2024-01-01T00:00:01Z", "causation_id": None, "correlation_id": "c", "payload": {"composite": i}} | more


def rows(spark, path):
    return eventlog.read(spark, str(path), splitbytes="300").orderBy("ordinal").collect()


def test_round_trip_and_conflict(spark, tmp_path):
    log = str(tmp_path / "log.jsonl")
    eventlog.append(log, [event(1), event(2)], {"lead/a": 0})
    eventlog.append(log, [event(3), event(1, "lead/b")], {"lead/a": 2, "lead/b": 0})
    with pytest.raises(eventlog.Conflict):
        eventlog.append(log, [event(3)], {"lead/a": 2})
    got = rows(spark, log)
    assert [(r.stream, r.seq) for r in got] == [("lead/a", 1), ("lead/a", 2), ("lead/a", 3), ("lead/b", 1)] and got[0].ordinal == 0
    end = eventlog.committed_end(log)
    assert eventlog.append(log, [event(4)], {"lead/a": 3}, end) == eventlog.committed_end(log)
    with pytest.raises(eventlog.Conflict):
        eventlog.append(log, [event(4)], {"lead/a": 3}, end)
    assert json.loads(got[0].payload) == {"composite": 1} and got[0].causation_id is None


def test_torn_tail(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    eventlog.append(str(log), [event(1)], {})
    whole = log.read_bytes()
    for tail in (b'{"a', json.dumps(event(2)).encode(), "é".encode()[:1]):
        log.write_bytes(whole + tail)
        assert len(rows(spark, log)) == 1
    eventlog.append(str(log), [event(2)], {"lead/a": 1})
    assert [r.seq for r in rows(spark, log)] == [1, 2]


@pytest.mark.parametrize("line", ["{", json.dumps(event(2, schema_version=2)), json.dumps(event(2, envelope_version=9)), '{"id": 1}'])
def test_committed_damage_raises(spark, tmp_path, line):
    log = tmp_path / "log.jsonl"
    log.write_text(json.dumps(event(1)) + "\n" + line + "\n")
    at = len(json.dumps(event(1))) + 1
    with pytest.raises(Exception, match=f"line at byte {at}: "):
        rows(spark, log)
    with pytest.raises(Exception, match=f"line at byte {at}: "):  # nothing of the line is read
        eventlog.read(spark, str(log)).count()
    assert eventlog.line_number(str(log), at) == 2


def test_missing_file_is_empty(spark, tmp_path):
    assert rows(spark, tmp_path / "none") == []


def test_stream_reads_what_is_committed(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    eventlog.append(str(log), [event(1), event(2)], {})
    with log.open("ab") as f:
        f.write(b'{"torn')
    q = eventlog.read_stream(spark, str(log)).writeStream.format("memory").queryName("log_rows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    q.stop()
    assert [r.seq for r in spark.table("log_rows").orderBy("ordinal").collect()] == [1, 2]


def test_ranges_of_any_size_hold_each_line_once(tmp_path):
    log = tmp_path / "log"
    parts = [b"a" * (i % 7) + b"\xc3\xa9" * (i % 3) for i in range(90)]
    log.write_bytes(b"\n".join(parts) + b"\ntorn")
    whole = list(eventlog.lines(str(log), 0, 10**6))
    assert [x for _, x in whole] == parts and all(log.read_bytes()[at : at + len(x)] == x for at, x in whole)
    for size in (1, 2, 5, 64, 300):
        assert [x for at in range(0, log.stat().st_size, size) for x in eventlog.lines(str(log), at, at + size)] == whole
    assert eventlog.committed_end(str(log)) == log.stat().st_size - 4 and eventlog.committed_end(str(tmp_path / "none")) == 0


def test_upcasts_and_overlay(spark, tmp_path):
    log = str(tmp_path / "log.jsonl")
    eventlog.append(log, [event(1), event(2, schema_version=2), event(1, "lead/b", schema_version=3)], {})
    n = lambda p: F.variant_get(p, "$.composite", "long")
    steps = {("scored", 1): lambda p: F.to_variant_object(F.struct(n(p).alias("composite"), F.lit(True).alias("two"))), ("scored", 2): lambda p: F.parse_json(F.concat(F.regexp_replace(F.to_json(p), "}$", ""), F.lit(',"three":'), n(p).cast("string"), F.lit("}")))}
    df = eventlog.read(spark, log, steps, {"scored": 3})
    got = [(r.schema_version, json.loads(r.payload)) for r in df.orderBy("ordinal").collect()]
    assert got == [(3, {"composite": 1, "two": True, "three": 1}), (3, {"composite": 2, "three": 2}), (3, {"composite": 1})]
    more = spark.createDataFrame([(5, "lead/a", 3), (6, "lead/c", 1)], "ordinal long, stream string, seq long")
    both = eventlog.overlay(df, more)
    assert [r.stream for r in both.orderBy("ordinal").collect()] == ["lead/a", "lead/a", "lead/b", "lead/a", "lead/c"] and eventlog.stream_of(both, "lead/a").count() == 3
    with pytest.raises(Exception, match="unknown version 1/1 of scored"):
        eventlog.read(spark, log, {}, {"scored": 3}).collect()


def test_writer_appends_what_tasks_stage(spark, tmp_path):
    log = str(tmp_path / "log.jsonl")
    eventlog.append(log, [event(1)], {})
    df = eventlog.read(spark, log)
    more = df.crossJoin(spark.range(1, 6).withColumnRenamed("id", "n")).selectExpr("ordinal", "envelope_version", "concat(id, '-', n) as id", "stream", "seq + n as seq", "type", "schema_version", "occurred_at", "recorded_at", "id as causation_id", "correlation_id", "payload")
    eventlog.write(more.coalesce(1), log, eventlog.committed_end(log))
    got = rows(spark, log)
    assert [r.seq for r in got] == [1, 2, 3, 4, 5, 6] and got[5].causation_id == "e1" and got[0].occurred_at == got[5].occurred_at
    assert [p.name for p in tmp_path.iterdir()] == ["log.jsonl"]
    with pytest.raises(Exception, match="has grown"):
        eventlog.write(more, log, 1)
    assert [p.name for p in tmp_path.iterdir()] == ["log.jsonl"]


def test_a_commit_that_fails_leaves_nothing(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log.jsonl")
    eventlog.append(log, [event(1)], {})
    before = (tmp_path / "log.jsonl").read_bytes()
    w = eventlog._Writer({"path": log})
    parts = []
    for i in (1, 2):
        parts.append(f"{log}.{w.batch}-{i}-0")
        with open(parts[-1], "wb") as f:
            f.write(json.dumps(event(i + 1)).encode() + b"\n")
    os.remove(parts[1])  # the second part can't be read
    with pytest.raises(FileNotFoundError):
        w.commit([eventlog._Staged(p) for p in parts])
    assert (tmp_path / "log.jsonl").read_bytes() == before and [p.name for p in tmp_path.iterdir()] == ["log.jsonl"]
    # a task that fails ends the batch: no part of it is appended, none stays
    bad = eventlog.read(spark, log).withColumn("payload", F.lit("{"))
    with pytest.raises(Exception, match="payload of event e1 is not JSON"):
        eventlog.write(bad, log)
    assert (tmp_path / "log.jsonl").read_bytes() == before and [p.name for p in tmp_path.iterdir()] == ["log.jsonl"]


def test_blocks_of_long_lines_and_odd_bytes(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    big = event(1, payload={"t": "é" * 300_000})
    log.write_bytes(b"\n \n" + json.dumps(big, ensure_ascii=False).encode() + b"\n\n" + json.dumps(event(2)).encode() + b"\n")
    for size in (1000, 100_000, 10**7):
        assert [(r.seq, r.ordinal) for r in eventlog.read(spark, str(log), splitbytes=size).orderBy("ordinal").collect()] == [(1, 3), (2, log.stat().st_size - len(json.dumps(event(2))) - 1)]
    log.write_bytes(json.dumps(event(1)).encode()[:-2] + b',"x":"\xff"}}\n')
    with pytest.raises(Exception, match="line at byte 0: not UTF-8"):
        rows(spark, log)


@given(st.integers(0, 3000), st.integers(0, 3000), st.one_of(st.none(), st.integers(1, 3000)))
def test_budget(matches, balance, budget):
    spent = 0

    def page(offset, limit):
        nonlocal spent
        n = min(limit, matches - offset)
        if n and spent + n > balance:
            raise CreditsExhausted(n)
        spent += n
        return list(range(offset, offset + n)), matches - offset - n

    def credit():
        return balance - spent

    if balance == 0:
        with pytest.raises(CreditsExhausted):
            fetch_within_budget(page, credit, budget)
        return
    out = fetch_within_budget(page, credit, budget)
    assert out.spent == spent == len(out.records) == min(matches, balance, budget if budget is not None else matches)
    assert out.records == list(range(spent)) and PAGE == 500


def test_error_after_records_keeps_them():
    def page(offset, limit):
        if offset:
            raise OSError("down")
        return list(range(limit)), 900

    out = fetch_within_budget(page, lambda: None)
    assert out.spent == 500 and out.error == "down" and out.truncated == 900
