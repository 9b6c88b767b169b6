import numpy as np
from pyspark.sql import functions as F

from skein.llm import mtree


def brute(rows, k=10):
    out = []
    for q, a in rows:
        if q % 100 == 0:
            scored = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_tree_discards_and_stays_exact():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8)) * 1000
    v = (centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 8)) * 20).astype(np.int64)
    most = int((v * v).sum(axis=1).max())
    tree = mtree.Tree(mtree.build_pages(np.arange(3000), v, most), most)
    assert all(len(p["ids"]) <= mtree.PAGE for p in tree.pages)
    for q in range(0, 3000, 97):
        scores = v @ v[q]
        want = sorted(((-int(s), i) for i, s in enumerate(scores) if i != q))[:10]
        assert tree.search(v[q], q, 10, -np.inf) == [(-s, i) for s, i in want]
    assert tree.computed < 0.6 * 3000 * 31


def test_frame(spark):
    rng = np.random.default_rng(2)
    data = [(int(i), (rng.integers(-3, 4, 6) / 4).tolist()) for i in range(0, 1500)]
    data += [(5000 + i, data[7][1]) for i in range(300)]  # many equal vectors
    odd = [(100, None), (9000, [0.5, None]), (9100, [float("nan")] * 6), (9200, [float("inf")] * 6), (None, [1.0] * 6), data[3], data[3]]
    df = spark.createDataFrame([(*r, "x") for r in data + odd], "vec_id long, embedding array<float>, score string").repartition(3)
    got = sorted(tuple(r) for r in mtree.top_k(df, df.filter(F.col("vec_id") % 100 == 0), cell_rows=256, seed_rows=64).collect())
    ints = [(i, [int(np.floor(1024 * np.float32(x))) for x in v]) for i, v in data]
    assert got == brute(ints)


def test_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, [])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in mtree.top_k(df, df.filter("vec_id = 0")).collect())
    assert got == [(0, 1, 1, 1024 * 1024), (0, 2, 2, 0)]
    none = df.limit(0)
    assert mtree.top_k(none, none).count() == 0


def test_table_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = sorted(tuple(r) for r in mtree.op5_mtree_topk(spark, "/root/testdata/sf0.01").collect())
    ints = [(r.vec_id, [int(np.floor(1024 * float(x))) for x in r.embedding]) for r in rows.collect()]
    assert got == brute(ints)


def test_queries_visit_few_cells():
    """Clustered rows: under its true bound a query reaches a small share of the cells, and no cell that holds a result."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 8)) * 1000
    v = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) * 20).astype(np.int64)
    most = int((v * v).sum(axis=1).max())
    cells = mtree.Cells(v[:64], most)
    cell, far = cells.nearest(v)
    radii = np.full(64, -1.0)
    np.maximum.at(radii, cell, far + 1e-6)
    visits = 0
    for q in range(0, 4000, 97):
        scores = v @ v[q]
        tenth = np.sort(np.delete(scores, q))[-10]
        to = cells.reached(v[q], float(tenth), radii)
        assert set(cell[scores >= tenth]) <= set(to)
        visits += len(to)
    assert visits < 0.25 * 64 * 42
