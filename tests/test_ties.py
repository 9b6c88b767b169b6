"""Ties without number, and alternatives with equal texts."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skein.operators import retrieval
from skein.sources.shared import recorded


def test_equal_scores_are_not_sorted(monkeypatch):
    """A block of queries that every row meets with the same score sends k rows a query, of smallest ids."""
    rng = np.random.default_rng(1)
    ids = rng.permutation(4096).astype("<i8")
    v = np.ones((4096, 4))
    v[ids == 4000] = 2.0
    q = np.vstack([np.zeros((1023, 4)), np.ones((1, 4))])
    row = {"q_n": [1024], "q_ids": [np.arange(1024).astype("<i8").tobytes()], "q_v": [q.tobytes()], "n": [4096], "ids": [ids.tobytes()], "v": [v.tobytes()], "size": [4]}
    batch = pa.RecordBatch.from_pydict({c: pa.array(x, pa.binary() if isinstance(x[0], bytes) else pa.int32()) for c, x in row.items()})
    sorted_rows = []
    inner = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorted_rows.append(len(keys[0])) or inner(keys))
    found = list(retrieval._best(5, 6)([batch]))
    assert sum(sorted_rows) < 10 * 1024
    rows = [r for x in found for r in x.to_pylist()]
    assert [r["id"] for r in rows if r["query_id"] == 17] == [0, 1, 2, 3, 4]
    assert [r["id"] for r in rows if r["query_id"] == 1023] == [4000, 0, 1, 2, 3]


def test_alternatives_are_one_search(spark):
    docs = [(k, f"w{k % 7} w{k % 5} common", [float(k % 3), 1.0], 0) for k in range(60)]
    corpus = spark.createDataFrame(docs, "id long, text string, vector array<double>, created long")
    queries = spark.createDataFrame([(q, "unknown", [0.0, 0.0]) for q in range(6)], "query_id long, text string, vector array<double>")
    alts = [(q, a, f"w{q % 7} w{(q + a // 2) % 5}" if q else None, [1.0, float(a)]) for q in range(6) for a in (1, 2, 3)]
    alts = spark.createDataFrame(alts, "query_id long, alt_no int, text string, vector array<double>")
    with recorded() as paths:
        got = sorted(map(tuple, retrieval.hybrid(queries, corpus, 0, expansions=alts).collect()))
    assert sum("query-terms" in p for p in paths) == 2
    index = retrieval.LexicalIndex.build(corpus)
    rankings = [retrieval.vector_top_k(queries, corpus), retrieval.bm25(queries, corpus, 20, index)]
    for number in (1, 2):
        one = alts.filter(F.col("alt_no") == number)
        rankings += [retrieval.vector_top_k(one, corpus), retrieval.bm25(one, corpus, 20, index)]
    scored = retrieval.adjust(retrieval.reciprocal_rank_fusion(rankings), corpus, queries, 0)
    want = {(r.query_id, r.id): r.adjusted for r in scored.collect()}
    assert len(got) == 36 and all(abs(want[r[0], r[1]] - r[3]) < 1e-6 for r in got)


def test_counted_terms_are_not_tokenised_again(spark):
    """Coverage comes from the search's counts; only other pairs, and ids of several documents, need texts."""
    docs = [(k, f"w{k % 7} w{k % 5} common Café-{k % 3}", k * 1000) for k in range(60)] + [(60, "w1", 0), (60, "w1 w2", 0), (61, None, 5)]
    corpus = spark.createDataFrame(docs, "id long, text string, created long")
    queries = spark.createDataFrame([(q, f"w{q} w{q} other café") for q in range(5)] + [(7, "nowhere"), (8, None), (9, "W1"), (9, "w3 common")], "query_id long, text string")
    words, known = retrieval.bm25_shared(queries, corpus, 50)
    near = spark.createDataFrame([(q, i, r + 1) for q in (0, 1, 7, 8, 9) for r, i in enumerate([2, 59, 60, 61])], "query_id long, id long, rank int")
    fused = retrieval.reciprocal_rank_fusion([near, words])
    want = sorted(map(tuple, retrieval.adjust(fused, corpus, queries, 10**6).collect()))
    assert sorted(map(tuple, retrieval.adjust(fused, corpus, queries, 10**6, words, known).collect())) == want
    # Texts of counted pairs are not looked at.
    fused = fused.join(words.select("query_id", "id"), ["query_id", "id"], "left_semi").filter("id < 60 and query_id < 9")
    blank = corpus.withColumn("text", F.lit(None).cast("string"))
    want = sorted(map(tuple, retrieval.adjust(fused, corpus, queries, 10**6).collect()))
    assert sorted(map(tuple, retrieval.adjust(fused, blank, queries, 10**6, words, known).collect())) == want and len(want) > 100


def test_equal_vectors_are_asked_once_and_strangers_not_tokenised(spark, monkeypatch):
    """Two alternatives with one vector are one search; coverage of queries in words that no document has needs no texts."""
    docs = [(k, f"w{k % 7} common", [float(k % 3), 1.0], k * 1000) for k in range(60)]
    corpus = spark.createDataFrame(docs, "id long, text string, vector array<double>, created long")
    queries = spark.createDataFrame([(q, "unknown words", [0.0, 0.0]) for q in range(6)], "query_id long, text string, vector array<double>")
    alts = [(q, a, f"w{q % 7}", [1.0, 2.0 if q < 4 else float(a)] if q else None) for q in range(6) for a in (1, 2, 3)]
    alts = spark.createDataFrame(alts, "query_id long, alt_no int, text string, vector array<double>")
    asked, adjusted = [], []
    search, adjust = retrieval.vector_top_k, retrieval.adjust
    monkeypatch.setattr(retrieval, "vector_top_k", lambda q, *rest: asked.append(q.count()) or search(q, *rest))
    monkeypatch.setattr(retrieval, "adjust", lambda *rest: adjusted.append(rest) or adjust(*rest))
    got = sorted(map(tuple, retrieval.hybrid(queries, corpus, 10**6, expansions=alts).collect()))
    assert asked == [6, 1 + 3 + 4]
    rankings = [search(queries, corpus)]
    for number in (1, 2):
        one = alts.filter(F.col("alt_no") == number)
        rankings += [search(one, corpus), retrieval.bm25(one, corpus)]
    want = {(r.query_id, r.id): r.adjusted for r in adjust(retrieval.reciprocal_rank_fusion(rankings), corpus, queries, 10**6).collect()}
    assert len(got) == 36 and all(abs(want[r[0], r[1]] - r[3]) < 1e-6 for r in got)
    fused, _, _, now, shared, known = adjusted[0]
    blank = adjust(fused, corpus.withColumn("text", F.lit("unknown words")), queries, now, shared, known)
    assert {(r.query_id, r.id): r.adjusted for r in blank.collect()} == want
