import os

import pytest
from pyspark.sql import functions as F

from skein.sources.corpus_cache import CorpusCache, decode_chunks
from skein.sources.versions import VersionedTable


def chunks(spark, ids):
    return spark.createDataFrame([(k, f"text number {k}", [1.0, 2.0] if k % 2 else [1.0]) for k in ids], "id long, text string, vector array<double>")


@pytest.mark.parametrize("kind", ["table", "folder"])
def test_decoded_once(spark, tmp_path, kind):
    path = f"file://{tmp_path}/source"
    source = VersionedTable(spark, path, ["id"], 2) if kind == "table" else path
    add = source.append if kind == "table" else lambda df: df.write.mode("append").parquet(path)
    add(chunks(spark, range(10)))
    cache = CorpusCache(spark, source, lambda rows: decode_chunks(rows, 2))
    first = cache.corpus()
    assert sorted((r.id, r.vector is not None) for r in first.collect()) == [(k, k % 2 == 1) for k in range(10)]
    # The second look reads the decoded rows only.
    again = cache.corpus()
    assert cache.decoded == 1 and again.inputFiles() and not any("/source" in f for f in again.inputFiles())
    index = cache.index()
    assert cache.index() is index
    found = index.search(spark.createDataFrame([(0, "number 7")], "query_id long, text string"), 1)
    assert [r.id for r in found.collect()] == [7]
    old = [p.removeprefix("file://") for p in cache.paths()]
    assert len(old) == 2 and all(map(os.path.isdir, old))
    # An append is seen, and the rows of before go.
    add(chunks(spark, [10, 11]))
    assert cache.corpus().count() == 12 and cache.decoded == 2 and not any(map(os.path.exists, old))
    assert [r.id for r in cache.index().search(spark.createDataFrame([(0, "11")], "query_id long, text string")).collect()] == [11]
    held = [p.removeprefix("file://") for p in cache.paths()]
    cache.invalidate()
    assert cache.paths() == [] and not any(map(os.path.exists, held))
    assert cache.corpus().count() == 12 and cache.decoded == 3


def test_same_count_is_no_proof(spark, tmp_path):
    """A replaced row is seen, though the number of rows is the same."""
    table = VersionedTable(spark, f"file://{tmp_path}/t", ["id"], 2)
    table.append(chunks(spark, range(4)))
    cache = CorpusCache(spark, table, lambda rows: rows)
    cache.corpus()
    table.replace(chunks(spark, [1]).withColumn("text", F.lit("other")))
    assert cache.corpus().filter("text = 'other'").count() == 1
