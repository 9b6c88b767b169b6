import hashlib
import os

import pytest
from pyspark.sql import functions as F

from skein.llm import warc
from skein.llm.common import scratch


def rows():
    big, other = "<p>" + "x" * 200, "é" * 60
    return [
        (5, "http://a/ö", big), (3, "http://b", big), (9, None, big), (3, "http://c", "short"), (4, "u", "short"), (7, "u", other),
        (8, "u", other), (10, "u", None), (11, "u", ""), (None, "u", big), (12, "u", "y" * 300000),
    ]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "x") for r in rows()], "page_id long, url string, html string, digest string").repartition(4)
    root = scratch(spark, "warc-test")
    bounds = [5, 9]
    warc.write_archives(warc.mark_revisits(df), root, bounds, roll_bytes=400)
    got = sorted((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload) for r in warc.read_archives(spark, root).collect())
    want = []
    refers = {5: 3, 9: 3, 8: 7}
    for page, _, html in rows():
        data = (html or "").encode()
        to = refers.get(page)
        want.append((page or -1, "revisit" if to else "response", to, len(data), hashlib.sha256(data).hexdigest(), None if to else data))
    assert [x[:5] for x in got] == [x[:5] for x in sorted(want, key=lambda x: (x[0], x[1], x[2] or 0, x[3]))]
    assert sorted(bytes(x[5]) for x in got if x[5] is not None) == sorted(x[5] for x in want if x[5] is not None)
    names = sorted(n for n in os.listdir(root.removeprefix("file://")) if n.startswith("part-"))
    assert len(names) > 4
    setting = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("4", "16"):  # names and bytes follow from the rows, not from the cluster's settings
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            again = scratch(spark, "warc-test")
            warc.write_archives(warc.mark_revisits(df.repartition(int(partitions))), again, bounds, roll_bytes=400)
            assert names == sorted(n for n in os.listdir(again.removeprefix("file://")) if n.startswith("part-"))
            for n in names:
                a, b = (open(f"{r.removeprefix('file://')}/{n}", "rb").read() for r in (root, again))
                assert a == b
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", setting)
    assert not os.path.exists(f"{root.removeprefix('file://')}/_temporary")


def test_bounds_by_bytes(spark):
    df = spark.range(5000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("x"), F.when(F.col("id") < 500, 900).otherwise(100)).alias("html"))
    bounds = warc.shard_bounds(df, shard_bytes=90_000)
    assert bounds == warc.shard_bounds(df.repartition(3, "url"), shard_bytes=90_000)
    assert len(bounds) == 9 and 200 < bounds[2] < 400 and 1200 < bounds[5] < 2000


def test_commit_keeps_a_whole_file(tmp_path):
    files, path = warc._filesystem(str(tmp_path))
    (tmp_path / "a").write_bytes(b"new")
    warc._commit(files, f"{path}/a", f"{path}/final")
    assert (tmp_path / "final").read_bytes() == b"new"
    (tmp_path / "b").write_bytes(b"new")
    warc._commit(files, f"{path}/b", f"{path}/final")
    assert (tmp_path / "final").read_bytes() == b"new"


def test_empty(spark):
    root = scratch(spark, "warc-test")
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(warc.mark_revisits(df), root, warc.shard_bounds(df))
    assert warc.read_archives(spark, root).count() == 0


def test_damage_is_found():
    record = warc.make_record(1, "u", b"payload", None)
    headers, block = warc.parse_record(record)
    assert headers["content-type"].startswith("application/http") and block == warc.http_head(7) + b"payload"
    assert warc.parse_record(warc.make_record(2, "u", b"payload", 1))[1] == warc.http_head(7)
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"payload\r", b"pajload\r"))
