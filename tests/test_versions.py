import threading

import pytest
from pyspark.sql import functions as F

from skein.sources.versions import Snapshot, VersionedTable, sink


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/t", ["id"], 4)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, version long")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_changes_against_a_list(spark, table):
    held = [(k, f"t{k}", 0) for k in range(20)] + [(None, "n", 0)]
    assert table.append(frame(spark, held)) == 0
    table.append(frame(spark, [(3, "again", 0), (30, "new", 0)]))
    held += [(3, "again", 0), (30, "new", 0)]
    table.replace(frame(spark, [(3, "one", 1), (4, "two", 1)]), frame(spark, [(5, "", 0)]).select("id"))
    held = [r for r in held if r[0] not in (3, 4, 5)] + [(3, "one", 1), (4, "two", 1)]
    table.delete(spark.createDataFrame([(7,), (99,)], "id long"))
    held = [r for r in held if r[0] != 7]
    table.upsert(frame(spark, [(8, "old", -1), (9, "newer", 5), (40, "fresh", 0)]), "version")
    held = [r for r in held if r[0] != 9] + [(9, "newer", 5), (40, "fresh", 0)]
    assert rows(table.read()) == sorted(held, key=repr)
    assert table.compact() is not None and table.compact() == table.versions()[-1]
    assert rows(table.read()) == sorted(held, key=repr)
    assert all(len(v) == 1 for v in table.snapshot().folders.values())
    assert rows(table.lookup(spark.createDataFrame([(8,), (77,)], "id long"))) == [r for r in held if r[0] == 8]


def test_only_touched_buckets_are_copied(spark, table):
    table.append(frame(spark, [(k, "x", 0) for k in range(100)]))
    before = table.snapshot().folders
    table.replace(frame(spark, [(1, "y", 0)]))
    after = table.snapshot().folders
    assert len(before) == 4 and sum(before[k] != after[k] for k in before) == 1


def test_readers_see_one_snapshot(spark, table):
    table.append(frame(spark, [(1, "a", 0)]))
    old = table.read()
    table.overwrite(frame(spark, [(2, "b", 0)]))
    assert rows(old) == [(1, "a", 0)] == rows(table.read(0)) and rows(table.read()) == [(2, "b", 0)]


def test_repeated_and_killed_batches(spark, table, monkeypatch):
    batch = frame(spark, [(k, "x", 0) for k in range(10)])
    assert table.append(batch, ("w", 0)) == 0 and table.append(batch, ("w", 0)) is None
    assert table.append(batch, ("other", 0)) == 1
    assert table.read().count() == 20

    def killed(snapshot):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(table, "_publish", killed)
        table.append(batch, ("w", 1))
    assert table.read().count() == 20 and table.versions() == [0, 1]
    assert table.append(batch, ("w", 1)) == 2 and table.read().count() == 30
    # What the killed job left is named by no snapshot.
    assert len(table.vacuum(keep=1, older_than=3600)) == 0
    assert len(table.vacuum(keep=1, older_than=0)) == 1
    assert table.versions() == [2] and table.read().count() == 30


def test_a_killed_job_leaves_no_rows(spark, table):
    table.append(frame(spark, [(1, "a", 0)]))
    broken = frame(spark, [(k, "x", 0) for k in range(50)]).withColumn("text", F.when(F.col("id") == 49, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        table.append(broken, ("w", 0))
    assert rows(table.read()) == [(1, "a", 0)] and "w" not in table.snapshot().tokens


def test_two_writers(spark, table):
    """Both commits of one number are tried; the later one is made again on the newer snapshot."""
    table.append(frame(spark, [(0, "start", 0)]))
    threads = [threading.Thread(target=table.append, args=(frame(spark, [(k, "x", 0)]), (f"w{k}", 0))) for k in range(1, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [r[0] for r in rows(table.read())] == [0, 1, 2, 3, 4] and table.versions() == [0, 1, 2, 3, 4]
    last = table.snapshot()
    assert not table._publish(Snapshot(last.number, last.schema))


def test_stream_sink_survives_repeats(spark, table, tmp_path):
    frame(spark, [(k, "x", 0) for k in range(30)]).repartition(3).write.json(f"{tmp_path}/in")
    keep = sink(table, "q")

    def twice(df, batch):
        keep(df, batch)
        keep(df, batch)

    stream = spark.readStream.schema("id long, text string, version long").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    for marks in ("a", "b"):  # the second query has lost its checkpoint and delivers all batches once more
        stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{tmp_path}/{marks}").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r[0] for r in table.read().collect()) == list(range(30))


def test_empty_table(spark, table):
    with pytest.raises(ValueError, match="no snapshot"):
        table.read()
    assert table.delete(spark.createDataFrame([(7,)], "id long")) is None
    table.append(frame(spark, []))
    assert table.read().count() == 0 and table.read().columns == ["id", "text", "version"]
