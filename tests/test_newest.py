import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql.types import StructType

from skein.streaming.newest import NewestReader, NewestRows

SCHEMA = "id long, text string, dropped long"


def put(folder, number, ids, group=7):
    pq.write_table(pa.table({"id": pa.array(ids, pa.int64()), "more": ["x"] * len(ids), "text": [f"t{k}" for k in ids]}), f"{folder}/{number:04d}.parquet", row_group_size=group)


@pytest.fixture
def drain(spark, tmp_path):
    spark.dataSource.register(NewestRows)
    (tmp_path / "in").mkdir()

    def run():
        out = []
        stream = spark.readStream.format("newest_rows").schema(SCHEMA).option("capacity", 64).load(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(lambda df, n: out.append(sorted(map(tuple, df.collect())))).option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start().awaitTermination()
        return [b for b in out if b]

    return tmp_path / "in", run


def test_a_slow_reader_gets_the_newest(drain):
    folder, run = drain
    for k in range(3):
        put(folder, k, range(50 * k, 50 * k + 50))
    assert run() == [[(k, f"t{k}", 86) for k in range(86, 150)]]
    put(folder, 3, range(150, 160))  # less than the buffer holds: nothing is dropped
    assert run() == [[(k, f"t{k}", 0) for k in range(150, 160)]]
    assert run() == []
    put(folder, 4, range(160, 300), 1000)
    assert run() == [[(k, f"t{k}", 76) for k in range(236, 300)]]


def test_a_range_of_offsets_is_always_the_same(tmp_path):
    schema = StructType.fromDDL(SCHEMA)
    for k in range(4):
        put(tmp_path, k, range(30 * k, 30 * k + 30))
    first = NewestReader(schema, str(tmp_path), 64)

    def rows(reader, a, b):
        return [tuple(r.values()) for p in reader.partitions({"rows": a}, {"rows": b}) for batch in reader.read(p) for r in batch.to_pylist()]

    assert first.latestOffset() == {"rows": 120} and first.initialOffset() == {"rows": 0}
    once = rows(first, 10, 100)
    put(tmp_path, 4, range(120, 150))
    again = rows(NewestReader(schema, f"file://{tmp_path}", 64), 10, 100)
    assert once == again == [(k, f"t{k}", 26) for k in range(36, 100)]
    assert rows(first, 5, 5) == [] and first.latestOffset() == {"rows": 150}


def test_files_out_of_order_are_refused(tmp_path):
    put(tmp_path, 5, range(3))
    reader = NewestReader(StructType.fromDDL(SCHEMA), str(tmp_path), 64)
    reader.latestOffset()
    put(tmp_path, 4, range(3))
    with pytest.raises(ValueError, match="in order"):
        reader.latestOffset()


def test_schema_is_asked_for(spark, tmp_path):
    spark.dataSource.register(NewestRows)
    with pytest.raises(Exception, match="dropped"):
        spark.readStream.format("newest_rows").schema("id long").load(str(tmp_path)).writeStream.format("noop").trigger(availableNow=True).start().awaitTermination()
