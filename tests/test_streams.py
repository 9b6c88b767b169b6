import json
import os
from datetime import UTC, datetime

import pytest

from skein.operators import meetings
from skein.streaming import stateful, transcripts


def batches(folder, parts):
    os.makedirs(folder, exist_ok=True)
    for k, part in enumerate(parts):
        with open(f"{folder}/{k:03d}.json", "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in part)
        os.utime(f"{folder}/{k:03d}.json", (1_700_000_000 + 10 * k,) * 2)  # files are taken by their times


def drain(stream, mode, marks):
    out = []
    stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return out


def test_assembly_goes_on_after_a_restart(spark, tmp_path):
    names = ("session_id", "seq", "text", "is_final", "start", "end")
    said = ["Hello", "Hello world", "hello world", "Next", "Ne", "Other", None, "Last", "Last one", "More"]
    rows = [dict(zip(names, (s, k, t, k % 4 != 3, k * 0.5, k * 0.5 + 2), strict=True)) for s in "ab" for k, t in enumerate(said)]
    parts = [[r for r in rows if r["seq"] % 3 == 0 and r["seq"] < 4 or r["seq"] < 3], [r for r in rows if 3 <= r["seq"] < 6], [r for r in rows if 2 <= r["seq"]]]
    seen = {}
    # Each run takes one more file, with the checkpoint of the one before.
    for n in (1, 2, 3):
        batches(f"{tmp_path}/in", parts[:n])
        for r in drain(stateful.assemble_stream(transcripts.read_updates(spark, f"{tmp_path}/in")), "update", f"{tmp_path}/marks"):
            seen[(r.session_id, r.line)] = (r.text, r.start, r.end)
    fresh = {(r["session_id"], r["seq"]): r for r in rows}
    df = spark.createDataFrame([tuple(r[c] for c in names) for r in fresh.values()], "session_id string, seq long, text string, is_final boolean, start double, end double")
    want = {(r.session_id, r.line): (r.text or "", r.start, r.end) for r in meetings.assemble(df.filter("is_final").fillna("", ["text"])).collect()}
    assert seen == want


def at(ms):
    return datetime.fromtimestamp(1_700_000_000 + ms / 1000, UTC).isoformat()


def said(*rows):
    return [{"session_id": s, "ts": at(ms), "text": t} for s, ms, t in rows]


@pytest.fixture
def ends(spark, tmp_path):
    def run(*parts):
        batches(f"{tmp_path}/in", parts)
        stream = spark.readStream.schema("session_id string, ts timestamp, text string").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        return sorted((r.session_id, r.text, round(r.ended_at.replace(tzinfo=UTC).timestamp() * 1000) - 1_700_000_000_000) for r in drain(stateful.turn_ends(stream), "append", f"{tmp_path}/marks"))

    return run


def test_a_pause_fires_once(ends):
    clock = [said(("clock", t, "tick")) for t in (2000, 4000, 6000)]
    assert ends(said(("a", 0, "hel"), ("a", 300, "hello "), ("b", 0, "  ")), said(("a", 500, "hello")), *clock) == [("a", "hello", 1100), ("clock", "tick", 2800)]


def test_a_change_resets_the_pause(ends):
    got = ends(said(("a", 0, "one")), said(("a", 700, "one two")), said(("a", 1499, "one two three")), said(("clock", 5000, "x")), said(("clock", 9000, "x")))
    assert got == [("a", "one two three", 2299), ("clock", "x", 5800)]


def test_a_pause_inside_a_batch_and_a_second_turn(ends):
    got = ends(said(("a", 0, "one"), ("a", 800, "two"), ("a", 1599, "three")), said(("clock", 9000, "")), said(("a", 9500, "four")), said(("clock", 20_000, "")), said(("clock", 30_000, "")))
    assert got == [("a", "four", 10_300), ("a", "one", 800), ("a", "three", 2399)]


def test_no_end_without_speech(ends):
    assert ends(said(("a", 0, ""), ("a", 100, None)), said(("clock", 9000, "")), said(("clock", 19_000, ""))) == []


def test_state_is_read_and_written_once_a_batch():
    """Each look at the state is a round trip to the JVM: one read, and one write where something is new."""
    from pyspark.sql import Row

    from skein.streaming.stateful import LineAssembler

    calls, held = [], {}

    class Value:
        def __init__(self, name):
            self.name = name

        def get(self):
            calls.append("get")
            return held.get(self.name)

        def exists(self):
            calls.append("exists")
            return self.name in held

        def update(self, value):
            calls.append("update")
            held[self.name] = value

    class Handle:
        def getValueState(self, name, schema):
            return Value(name)

    row = lambda seq, text, start: Row(seq=seq, is_final=True, text=text, start=start, end=start + 1.0)
    machine = LineAssembler()
    machine.init(Handle())
    first = list(machine.handleInputRows(("s",), iter([row(1, "a", 0.0), row(2, "b", 5.0)]), None))
    assert [(r.line, r.text) for r in first] == [(0, "a"), (1, "b")] and calls == ["get", "update"]
    again = list(machine.handleInputRows(("s",), iter([row(2, "b", 5.0), row(3, "b more", 5.0)]), None))
    assert [(r.line, r.text) for r in again] == [(1, "b more")] and calls == ["get", "update"] * 2
    assert list(machine.handleInputRows(("s",), iter([row(3, "b more", 5.0)]), None)) == [] and calls[4:] == ["get"]
