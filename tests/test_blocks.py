"""Blocks of queries in several turns give what one turn gives, and the corpus is packed once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import clustering, retrieval
from skein.sources.shared import recorded


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [(int(k), int(k % 3), int(k * 7 % 101), rng.normal(size=8 if k % 10 else 5).round(2).tolist()) for k in range(600)]
    data += [(1000, 0, 5, None), (1001, None, 5, [1.0] * 8), (1002, 0, 5, [])]
    return spark.createDataFrame(data, "id long, grp int, created long, vector array<double>").repartition(4).cache()


def plain(rows):
    return [r for r in rows.collect() if r.vector]


@pytest.mark.parametrize("size", [2000, 1 << 25])
def test_vector_top_k(spark, rows, monkeypatch, size):
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", size)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 16)
    monkeypatch.setattr(retrieval, "PIECE", 64)
    asked = rows.filter("id % 3 = 0").select(F.col("id").alias("query_id"), "vector")
    with recorded() as paths:
        found = retrieval.vector_top_k(asked, rows, 4)
    assert sum("vector-pieces" in p for p in paths) == (1 if size == 2000 else 0)
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in found.collect())
    want = []
    held = plain(rows)
    for q in held:
        if q.id % 3 == 0:
            scored = sorted((-round(float(np.dot(q.vector, d.vector)), 6), d.id) for d in held if len(d.vector) == len(q.vector))
            want += [(q.id, n + 1, i, -s) for n, (s, i) in enumerate(scored[:4])]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], atol=2e-6)


@pytest.mark.parametrize("size", [2000, 1 << 25])
def test_continuity(rows, monkeypatch, size):
    monkeypatch.setattr(clustering, "BROADCAST_BYTES", size)
    monkeypatch.setattr(clustering, "PIECE", 16)
    monkeypatch.setattr(clustering, "HELD", 100)
    found = clustering.continuity(rows, rows.filter("id % 2 = 0"), 0.5, 2)
    got = sorted((r.id, r["rank"], r.prior_id) for r in found.collect())
    want, held = [], [r for r in plain(rows) if r.grp is not None]
    for a in held:
        near = [(-round(float(np.dot(a.vector, b.vector)), 6), b.id) for b in held if b.id % 2 == 0 and b.grp == a.grp and b.created < a.created and len(a.vector) == len(b.vector)]
        want += [(a.id, n + 1, i) for n, (s, i) in enumerate(sorted(x for x in near if -x[0] >= 0.5)[:2])]
    assert got == sorted(want)


def test_budget_is_cut_before_the_shuffle(spark):
    data = spark.range(3000).select((F.col("id") % 2).alias("k"), "id", F.when(F.col("id") % 5 == 0, 0).otherwise(F.col("id") % 7).alias("n"))
    found = retrieval.pack_budget(data, "k", [F.col("id")], F.col("n"), 40, force_first=True)
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    want = []
    for k in (0, 1):
        used = 0
        for i in range(k, 3000, 2):
            used += 0 if i % 5 == 0 else i % 7
            if used > 40:
                break
            want.append((k, i, used))
    assert sorted((r.k, r.id, r.used) for r in found.collect()) == sorted(want)
