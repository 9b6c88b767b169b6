"""Relevance by labels."""

from skein.operators import evaluation


def test_relevance_by_labels(spark):
    """Metrics are those of the pairs, also where rows have several labels or none; the plan makes no pairs."""
    rows = [(k, k % 4) for k in range(40)] + [(1, 2), (1, 1), (5, 3), (50, None)]
    rows = spark.createDataFrame(rows, "id long, label int")
    asked = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, None), (4, 9), (6, 0), (6, 0)], "query_id long, label int")
    ranked = spark.createDataFrame([(q, i, p + 1) for q in (1, 2, 3, 4, 7) for p, i in enumerate([4, 1, 5, 2, 3, 10])], "query_id long, id long, position long")
    pairs = asked.join(rows, "label").select("query_id", "id")
    want = sorted(map(tuple, evaluation.per_query(ranked, pairs).collect()))
    got = evaluation.per_query_by_label(ranked, asked, rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
