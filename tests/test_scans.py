import random

import pytest
from pyspark.sql import functions as F

from skein.operators import meetings, relations, scans


def plain(events):
    out, state = [], {}
    for key, seq, event in sorted(events, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        before = state.get(key, "idle")
        state[key] = meetings.STATES.get((event, before), before)
        out.append((key, seq, event, state[key], meetings.COMMANDS.get((event, before))))
    return sorted(out, key=repr)


EVENTS = ["start", "began", "ended_resume", "ended", "stop", "reset", "route_changed", "other"]


@pytest.mark.parametrize("piece", [2, 64, 4096])
def test_machine_against_a_fold(spark, monkeypatch, piece):
    monkeypatch.setattr(scans, "PIECE", piece)
    rng = random.Random(piece)
    events = [(rng.choice([None, 1, 2, 3]), k, rng.choice(EVENTS)) for k in range(3000)] + [(9, 0, "start")]
    df = spark.createDataFrame(events, "key long, seq long, event string").repartition(7)
    assert sorted(map(tuple, meetings.run_states(df).collect()), key=repr) == plain(events)
    assert meetings.run_states(df.limit(0)).count() == 0


def test_one_key_spans_many_tasks(spark):
    n = 400_000
    event = F.element_at(F.array(*[F.lit(e) for e in EVENTS]), (F.xxhash64("id") % 8 + 8).cast("int") % 8 + 1)
    df = spark.range(n).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("seq"), event.alias("event"))
    found = meetings.run_states(df)
    rows = scans.numbered(df, "key", ["seq"])
    parts = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 0.6 * n
    want = plain([tuple(r) for r in df.collect()])
    assert sorted(map(tuple, found.collect()), key=repr) == want


@pytest.mark.parametrize("piece", [2, 4096])
def test_following(spark, monkeypatch, piece):
    monkeypatch.setattr(scans, "PIECE", piece)
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b"]), k, rng.choice([None, k * 10])) for k in range(300)]
    df = spark.createDataFrame(rows, "key string, n long, v long").repartition(5)
    got = scans.following(scans.numbered(df, "key", ["n"]), "key", "v", "next").select("key", "n", "next").collect()
    for key in (None, "a", "b"):
        mine = [r for r in rows if r[0] == key]
        want = {r[1]: (mine[i + 1][2] if i + 1 < len(mine) else None) for i, r in enumerate(mine)}
        assert {r.n: r.next for r in got if r.key == key} == want


def test_active_time(spark):
    rows = [("u", k * 10, k, k % 3 != 0) for k in range(50)]
    df = spark.createDataFrame(rows, "user string, s long, tie long, on boolean").withColumn("ts", F.timestamp_seconds("s"))
    assert relations.active_time(df, "user", "ts", "tie", F.col("on")).first().active == sum(10 for k in range(49) if k % 3)
