import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.operators import lexical
from skein.operators.lexical import LexicalIndex


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain(docs, queries, k):
    """BM25 of all pairs."""
    counts = {i: Counter(tokens(t)) for i, t in docs}
    size = {i: sum(c.values()) for i, c in counts.items()}
    n, mean = len(docs), max(1.0, sum(size.values()) / max(1, len(docs)))
    df = Counter(t for c in counts.values() for t in c)
    out = []
    for q, text in queries:
        scored = []
        for i, c in counts.items():
            s = 0.0
            for t in sorted(set(tokens(text))):
                if c[t]:
                    s += math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * size[i] / mean))
            if round(s, 6) > 0:
                scored.append((-round(s, 6), i))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def zipf(rng, n, v=400):
    return " ".join(f"w{min(v, int(1 / (rng.random() + 1e-9) ** 0.8))}" for _ in range(n))


def corpus(rng, n):
    docs = [(k, zipf(rng, rng.randrange(1, 80))) for k in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "..."), (n + 3, docs[0][1]), (n + 4, docs[0][1]), (n + 5, "Café-CAFÉ w1"), (n + 6, "rare " * 500)]
    return docs


@pytest.mark.parametrize("k", [1, 3, 20])
def test_against_all_pairs(spark, monkeypatch, k):
    monkeypatch.setattr(lexical, "PIECE_DOCS", 64)
    monkeypatch.setattr(lexical, "PACK_QUERIES", 5)
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", 3000)
    rng = random.Random(k)
    docs = corpus(rng, 500)
    queries = [(q, zipf(rng, rng.randrange(1, 60))) for q in range(23)] + [(50, "unknown words"), (51, None), (52, "rare café")]
    index = LexicalIndex.build(spark.createDataFrame(docs, "id long, text string").repartition(3))
    got = sorted(tuple(r) for r in index.search(spark.createDataFrame(queries, "query_id long, text string"), k).select("query_id", "id", "score", "rank").collect())
    want = plain(docs, queries, k)
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want], atol=2e-6)
    df = {r.term: r.df for r in index.frequencies().collect()}
    assert df == Counter(t for _, text in docs for t in set(tokens(text)))


def test_pruning(spark):
    """Long queries over real texts: few documents are scored in full, and a task sends on k rows a query at most."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    index = LexicalIndex.build(docs.coalesce(1))
    df = {r.term: r.df for r in index.frequencies().collect()}
    batch = index.pieces.toArrow().to_batches()[0]
    piece = lexical.Piece({c: batch.column(i)[0] for i, c in enumerate(batch.schema.names)}, index.mean)
    place = {t.as_py(): k for k, t in enumerate(piece.terms)}
    asked = [r.text for r in docs.filter("id % 10 = 0").collect()]
    scored = 0
    for text in asked:
        terms = sorted({place[t] for t in tokens(text) if t in place})
        names = piece.terms.to_pylist()
        idf = np.array([math.log((index.n - df[names[t]] + 0.5) / (df[names[t]] + 0.5) + 1) for t in terms])
        left, _ = piece.search(np.array(terms, np.int64), idf, 20, 0.0)
        scored += len(left)
    assert scored < 0.1 * len(asked) * piece.n
    # A bar that no document reaches leaves nothing.
    assert len(piece.search(np.array(terms, np.int64), idf, 20, 1e6)[0]) == 0


def test_a_task_sends_its_best_only(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PIECE_DOCS", 16)
    rng = random.Random(1)
    index = LexicalIndex.build(spark.createDataFrame(corpus(rng, 300), "id long, text string").coalesce(1))
    terms = spark.createDataFrame([(q, f"w{t}", 1.0, 0) for q in range(3) for t in range(1, 9)], "query_id long, term string, idf double, pack long")
    rows = index.pieces.join(lexical._packed(terms).hint("broadcast")).toArrow()
    sent = list(lexical._searched(4, index.mean, pa.int64(), pa.int64())(rows.to_batches()))
    assert rows.num_rows > 10 and sum(b.num_rows for b in sent) == 12


def test_kept_index_and_other_ids(spark, tmp_path):
    docs = spark.createDataFrame([("a", "red green"), ("b", "red"), ("c", None), (None, "red green blue")], "id string, text string")
    LexicalIndex.build(docs, f"{tmp_path}/index")
    found = LexicalIndex.open(spark, f"{tmp_path}/index").search(spark.createDataFrame([("q", "Red blue")], "query_id string, text string"))
    assert [(r.id, r.rank) for r in found.orderBy("rank").collect()] == [("b", 1), ("a", 2)]
    none = LexicalIndex.build(docs.limit(0)).search(spark.createDataFrame([("q", "red")], "query_id string, text string"))
    assert none.count() == 0 and none.columns == ["query_id", "id", "score", "rank"]


def test_many_queries_in_one_block(spark, monkeypatch):
    """Queries are summed together; single-precision sums lose no document, also of terms that most documents have."""
    rng = random.Random(8)
    docs = [(k, zipf(rng, rng.randrange(1, 60), 60)) for k in range(400)]
    monkeypatch.setattr(lexical, "PIECE_TOKENS", 2000)
    index = LexicalIndex.build(spark.createDataFrame(docs, "id long, text string").coalesce(1))
    assert 4 < index.pieces.count() < 20 and index.n == 400
    calls = []
    inner = lexical.Piece._sums
    monkeypatch.setattr(lexical.Piece, "_sums", lambda self, queries: calls.append(len(queries)) or inner(self, queries))
    terms = spark.createDataFrame([(q, t, math.log(400 / (1 + int(t[1:]))) + 1, 0) for q, text in docs[:50] for t in set(tokens(text))], "query_id long, term string, idf double, pack long")
    rows = index.pieces.join(lexical._packed(terms).hint("broadcast")).toArrow()
    sent = list(lexical._searched(5, index.mean, pa.int64(), pa.int64())(rows.to_batches()))
    assert sum(b.num_rows for b in sent) == 250 and max(calls) == 50


def test_bars_of_a_sample(spark, monkeypatch):
    """Rough sums of some pieces give bars, with which all pieces find the same and score few documents in full; packs go to a task once."""
    monkeypatch.setattr(lexical, "PIECE_DOCS", 64)
    rng = random.Random(5)
    docs = [(k, zipf(rng, rng.choice([2, 5, 40, 90]), 300)) for k in range(1500)]
    docs += [(None, docs[3][1])] * 30
    queries = [(q, zipf(rng, rng.choice([3, 60]), 300)) for q in range(40)]
    index = LexicalIndex.build(spark.createDataFrame(docs, "id long, text string").coalesce(1))
    asked = spark.createDataFrame(queries, "query_id long, text string")
    monkeypatch.setattr(lexical, "LEAST_PIECES", 10**9)
    without = sorted(map(tuple, index.search(asked, 5).collect()))
    monkeypatch.setattr(lexical, "LEAST_PIECES", 2)
    sent = []
    inner = LexicalIndex._found
    monkeypatch.setattr(LexicalIndex, "_found", lambda self, pieces, packed, *rest: sent.append((pieces, packed)) or inner(self, pieces, packed, *rest))
    found = sorted(map(tuple, index.search(asked, 5).collect()))
    assert found == without and len(found) == 200
    assert len(sent) == 2 and sent[0][0].count() < sent[1][0].count() == index.n_pieces > 20
    # The same in this process, where full scores can be counted.
    counts = []
    score = lexical.Piece._scores
    monkeypatch.setattr(lexical.Piece, "_scores", lambda self, docs, terms: counts.append(len(docs)) or score(self, docs, terms))
    scored = {}
    for name, packs in (("bars", sent[1][1]), ("none", sent[0][1])):
        counts.clear()
        rows = index.pieces.join(packs.hint("broadcast")).toArrow().to_batches()
        assert sum(b.num_rows for b in lexical._searched(5, index.mean, pa.int64(), pa.int64())(rows)) >= 200 * (name == "none")
        scored[name] = sum(counts)
    assert scored["bars"] < 0.7 * scored["none"]
