"""Texts and vectors travel to Python in small batches, and what a worker remembers is bounded."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skein.operators import embedding, retrieval


def test_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        rows = spark.range(3000).coalesce(1).select("id", F.lit("a b").alias("text"))
        assert embedding.embed(rows).count() == 3000
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 1024
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert embedding._place.cache_info().maxsize <= 1 << 15


def test_scores_are_held_in_parts():
    rng = np.random.default_rng(2)
    q, v = rng.normal(size=(300, 8)), rng.normal(size=(500, 8))
    columns = {"q_n": pa.array([300], pa.int32()), "q_ids": pa.array([np.arange(300).astype("<i8").tobytes()]), "q_v": pa.array([q.tobytes()])}
    columns |= {"n": pa.array([500], pa.int32()), "ids": pa.array([np.arange(500).astype("<i8").tobytes()]), "v": pa.array([v.tobytes()]), "size": pa.array([8], pa.int32())}
    found = list(retrieval._best(3, 6)([pa.RecordBatch.from_pydict(columns)]))
    assert len(found) == 3 and all(b.num_rows <= 3 * retrieval.SCORED for b in found)
    got = [(r["query_id"], r["id"]) for b in found for r in b.to_pylist()]
    assert got == [(k, i) for k in range(300) for i in sorted(range(500), key=lambda i: (-round(float(q[k] @ v[i]), 6), i))[:3]]
