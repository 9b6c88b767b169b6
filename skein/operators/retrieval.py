"""Ranked retrieval: BM25, vector top-k, reciprocal rank fusion, priors, MMR, the hybrid of all, packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import scores, text
from skein.operators.batches import map_batches
from skein.operators.lexical import LexicalIndex
from skein.sources.shared import stored

#: Vectors of a query block and of a corpus piece that are multiplied at once, and bytes of blocks broadcast at once.
QUERY_BLOCK, PIECE, BROADCAST_BYTES = 1024, 4096, 32 << 20
#: Queries of a block whose scores of a piece a task holds at once.
SCORED = 128
#: Stands for a document's length among its terms; no token is empty.
LENGTH = ""


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term, df of documents (id, text), with n and avg_len of the corpus: each document's distinct terms are counted in its task."""
    tokens = docs.select(text.tokenize(F.col("text")).alias("tokens"))
    terms = F.concat(F.coalesce(F.array_distinct("tokens"), F.array().cast("array<string>")), F.array(F.lit(LENGTH)))
    rows = tokens.select(F.greatest(F.coalesce(F.size("tokens"), F.lit(0)), F.lit(0)).alias("len"), F.explode(terms).alias("term"))
    counted = rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("len").alias("total"))
    stats = counted.filter(F.col("term") == LENGTH).select(F.col("df").alias("n"), F.round(F.greatest(F.lit(1.0), F.col("total") / F.col("df")), 6).alias("avg_len"))
    return counted.filter(F.col("term") != LENGTH).select("term", "df").join(F.broadcast(stats), F.lit(True))


def bm25(queries: DataFrame, docs: DataFrame, k: int = 20, index: LexicalIndex | None = None) -> DataFrame:
    """query_id, id, score, rank: Okapi BM25 of each query, positive scores, best ``k``; ties to smaller ids.

    ``index``: an index of the documents, to be used for several sets of queries; otherwise one is made for this search.
    """
    return (index or LexicalIndex.build(docs)).search(queries, k)


def bm25_shared(queries: DataFrame, docs: DataFrame, k: int = 20, index: LexicalIndex | None = None) -> tuple[DataFrame, DataFrame]:
    """``bm25`` with what ``adjust`` takes: numbers of shared terms, and the queries of which any document has a term."""
    return (index or LexicalIndex.build(docs)).search_shared(queries, k)


def top_per_query(scored: DataFrame, k: int | None) -> DataFrame:
    """Ranks (query_id, id, score) by score, ties to smaller ids, and keeps the first ``k``."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors (id, vector) packed by length into pieces: their number, length, ids and components as bytes."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def packed(size: int) -> pa.RecordBatch:
        ids, v = (np.concatenate(x) for x in zip(*held.pop(size), strict=True))
        columns = [pa.array([len(ids)], pa.int32()), pa.array([size], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([v.astype("<f8").tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["n", "size", "ids", "v"])

    for batch in batches:
        ids, vectors = batch.column(0), batch.column(1)
        bounds, flat = np.asarray(vectors.offsets), np.asarray(vectors.values.fill_null(float("nan")), float)
        usable = np.asarray(ids.is_valid()) & np.asarray(vectors.is_valid()) & (np.diff(bounds) > 0)
        ids = np.asarray(ids.fill_null(0), np.int64)
        for size in np.unique(np.diff(bounds)[usable]).tolist():
            at = np.flatnonzero(usable & (np.diff(bounds) == size))
            held.setdefault(size, []).append((ids[at], flat[bounds[at][:, None] + np.arange(size)]))
            if sum(len(x) for x, _ in held[size]) >= PIECE:
                yield packed(size)
    for size in list(held):
        yield packed(size)


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int = 20, decimals: int = 6) -> DataFrame:
    """query_id, id, score, rank by inner product of queries (query_id, vector) with (id, vector).

    Every query is scored against all rows, in blocks: queries are dealt into blocks of about QUERY_BLOCK, of which a
    bounded number of bytes is broadcast at a time, and each block is multiplied with pieces of the corpus; only the best
    ``k`` of a block and piece go on. The corpus is packed once, however many turns the blocks take. Vectors of another
    length than the query's are left out.
    """
    pack = "n int, size int, ids binary, v binary"
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    size = queries.agg(F.count("*").alias("n"), F.sum(F.size("vector").cast("long") * 8).alias("bytes")).first()
    blocks, turns = max(1, -(-size["n"] // QUERY_BLOCK)), max(1, -(-(size["bytes"] or 0) // BROADCAST_BYTES))
    if blocks > 1:
        asked = asked.repartition(blocks, F.xxhash64("query_id"))
    asked = map_batches(asked, _pieces, pack).select(*[F.col(c).alias(f"q_{c}") for c in ("n", "size", "ids", "v")])
    corpus = map_batches(vectors.select("id", F.col("vector").cast("array<double>").alias("vector")), _pieces, pack)
    if turns > 1:
        asked, corpus = stored(asked, "query-blocks"), stored(corpus, "vector-pieces")
    found = None
    for turn in range(turns):
        block = asked if turns == 1 else asked.filter(F.pmod(F.xxhash64("q_ids"), F.lit(turns)) == turn)
        pairs = corpus.join(F.broadcast(block), F.col("size") == F.col("q_size"))
        one = map_batches(pairs.select("q_n", "q_ids", "q_v", "n", "ids", "v", "size"), _best(k, decimals), "query_id long, id long, score double")
        found = one if found is None else found.union(one)
    return top_per_query(found, k)


def _best(k: int, decimals: int):
    """The best ``k`` rows of a corpus piece for each query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                q_n, q_ids, q_v, n, ids, v, size = (batch.column(c)[r].as_py() for c in range(7))
                ids, v = np.frombuffer(ids, "<i8"), np.frombuffer(v, "<f8").reshape(n, size)
                q_ids, q_v = np.frombuffer(q_ids, "<i8"), np.frombuffer(q_v, "<f8").reshape(q_n, size)
                for lo in range(0, q_n, SCORED):
                    yield best(q_ids[lo : lo + SCORED], q_v[lo : lo + SCORED], ids, v)

    def best(q_ids: np.ndarray, q_v: np.ndarray, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        n = len(ids)
        s = np.round(q_v @ v.T, decimals)
        bars = np.partition(s, n - k, axis=1)[:, n - k] if n > k else np.full(len(q_v), -np.inf)
        # Of rows that meet their bar in many places, the smallest ids there are enough.
        reached = s >= bars[:, None]
        tied = np.flatnonzero(np.count_nonzero(reached, axis=1) > 2 * k)
        if len(tied):
            by_id = np.argsort(ids, kind="stable")
            for q in tied.tolist():
                at = by_id[s[q, by_id] == bars[q]]
                reached[q, at[k:]] = False
        a, b = np.nonzero(reached)
        order = np.lexsort((ids[b], -s[a, b], a))
        a, b = a[order], b[order]
        first = np.searchsorted(a, np.arange(len(q_v)))
        top = np.arange(len(a)) - first[a] < k  # of equal scores, those of smaller ids
        a, b = a[top], b[top]
        return pa.RecordBatch.from_arrays([pa.array(q_ids[a]), pa.array(ids[b]), pa.array(s[a, b])], ["query_id", "id", "score"])

    return run


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int = scores.RRF_K) -> DataFrame:
    """query_id, id, fused, first_seen from rankings (query_id, id, rank): sums of 1 / (k + rank); ties by first appearance."""
    union = None
    for number, ranking in enumerate(rankings):
        part = ranking.select("query_id", "id", (F.lit(number * 1_000_000) + F.col("rank")).alias("seen"), (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("w"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("query_id", "id").agg(F.round(F.sum("w"), 9).alias("fused"), F.min("seen").cast("long").alias("first_seen"))


def adjust(fused: DataFrame, facts: DataFrame, queries: DataFrame, now: int, shared: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Fused rows with recency and term coverage added: query_id, id, adjusted. facts: (id, text, created).

    shared: (query_id, id, shared), numbers of terms that a search has counted; known: (query_id) of the queries of which any document
    has a term. Only the documents of other rows are tokenised.
    """
    q = queries.select("query_id", F.array_distinct(text.tokenize(F.col("text"))).alias("q_terms"))
    value = lambda covered: F.round(scores.adjusted(F.col("fused"), scores.recency_prior(F.col("created"), F.lit(now)), covered), 9).alias("adjusted")
    done = None
    if shared is not None:
        q = stored(q, "asked-terms")
        # A count belongs to one document and one query: where several have the id, texts are compared.
        one = facts.select("id", "created").join(fused.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.first("created").alias("created"), F.count("*").alias("docs"))
        asked = queries.groupBy("query_id").agg(F.count("*").alias("texts"))
        asked = asked.join(known.withColumn("known", F.lit(True)), "query_id", "left") if known is not None else asked.withColumn("known", F.lit(True))
        rows = fused.join(shared.select("query_id", "id", "shared"), ["query_id", "id"], "left").join(one, "id").join(asked, "query_id")
        count = F.coalesce("shared", F.when(F.col("known").isNull(), 0))
        rows = stored(rows.select(*fused.columns, "created", F.when((F.col("docs") == 1) & (F.col("texts") == 1), count).alias("shared")), "counted")
        counted = rows.filter("shared is not null").join(q.select("query_id", F.size("q_terms").alias("terms")), "query_id")
        done = counted.select("query_id", "id", "fused", value(scores.share(F.col("shared"), F.col("terms"))))
        fused = rows.filter("shared is null").select(*fused.columns).dropDuplicates(["query_id", "id"])
    # Only the found documents are tokenised.
    found = facts.select("id", "created", "text").join(fused.select("id").distinct(), "id", "left_semi")
    rows = fused.join(found.select("id", "created", text.tokenize(F.col("text")).alias("d_terms")), "id").join(q, "query_id")
    rows = rows.select("query_id", "id", "fused", value(scores.coverage(F.col("q_terms"), F.coalesce("d_terms", F.array().cast("array<string>")))))
    return rows if done is None else done.unionByName(rows)


def mmr_order(query: np.ndarray | None, pool: list[tuple[int, np.ndarray | None]], k: int, weight: float = 0.7) -> list[int]:
    """Greedy maximal marginal relevance of a pool in fused order; vector-less members fill what is left.

    With fewer than two usable vectors the pool's own order stands. Similarity to picked members counts from 0 up.
    """
    usable = [(i, v) for i, v in pool if v is not None and query is not None and len(v) == len(query)]
    if len(usable) < 2:
        return [i for i, _ in pool[:k]]
    relevance = [float(query @ v) for _, v in usable]
    picked: list[int] = []
    left = list(range(len(usable)))
    while left and len(picked) < k:
        best, best_value = left[0], -np.inf
        for c in left:
            near = max([0.0, *(float(usable[c][1] @ usable[p][1]) for p in picked)])
            value = weight * relevance[c] - (1 - weight) * near
            if value > best_value:
                best, best_value = c, value
        picked.append(best)
        left.remove(best)
    out = [usable[p][0] for p in picked]
    return out + [i for i, _ in pool if i not in out][: k - len(out)]


def mmr(pools: DataFrame, k: int = 6, weight: float = 0.7) -> DataFrame:
    """query_id, id, position from pools (query_id, place, id, vector, query_vector): one small group per query."""

    def work(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("place", "id", "vector", "query_vector", "query_id")), strict=True), key=lambda r: r[0])
        query = None if rows[0][3] is None else np.asarray(rows[0][3], float)
        order = mmr_order(query, [(r[1], None if r[2] is None else np.asarray(r[2], float)) for r in rows], k, weight)
        return pa.table({"query_id": pa.array([rows[0][4]] * len(order), pa.int64()), "id": pa.array(order, pa.int64()), "position": pa.array(range(1, len(order) + 1), pa.int64())})

    return pools.groupBy("query_id").applyInArrow(work, "query_id long, id long, position long")


def hybrid(
    queries: DataFrame, corpus: DataFrame, now: int, k: int = 6, depth: int = 20, pool: int = 12, expansions: DataFrame | None = None, priors: bool = True,
) -> DataFrame:
    """query_id, position, id, score: vector and BM25 rankings fused, adjusted, diversified.

    queries: (query_id, text, vector); corpus: (id, text, vector, created); expansions: (query_id, alt_no, text, vector),
    used only for queries whose retrieval is weak. The returned score is the adjusted fused one.
    """
    index = LexicalIndex.build(corpus.select("id", "text"))
    by_vector = stored(vector_top_k(queries, corpus, depth), "by-vector")
    by_words, known = bm25_shared(queries, corpus, depth, index)
    by_words = stored(by_words, "by-words")
    rankings = [by_vector, by_words]
    if expansions is not None:
        hits = by_words.groupBy("query_id").agg(F.count("*").alias("hits"))
        cosine = by_vector.groupBy("query_id").agg(F.max("score").alias("cosine"))
        weak = queries.select("query_id").join(hits, "query_id", "left").join(cosine, "query_id", "left")
        weak = weak.filter(scores.is_weak(F.coalesce("hits", F.lit(0)), F.col("cosine"))).select("query_id")
        alts = expansions.join(weak, "query_id", "left_semi").filter(F.col("alt_no") <= 2)
        alts = stored(alts.select("query_id", "alt_no", "text", "vector").withColumn("asked", F.monotonically_increasing_id()), "alternatives")
        # All alternatives are one search, in which equal texts, and equal vectors of a query, are asked once.
        first = alts.withColumn("first", F.min("asked").over(Window.partitionBy("text")))
        words = bm25(first.filter("asked = first").select(F.col("asked").alias("query_id"), "text"), corpus, depth, index)
        nearest = alts.withColumn("first", F.min("asked").over(Window.partitionBy("query_id", "vector")))
        near = vector_top_k(nearest.filter("asked = first").select(F.col("asked").alias("query_id"), "vector"), corpus, depth)
        found = [(near, nearest.select("query_id", "alt_no", "first")), (words, first.select("query_id", "alt_no", "first"))]
        found = [stored(f.withColumnRenamed("query_id", "first").join(of, "first").select("query_id", "alt_no", "id", "score", "rank"), "by-alternative") for f, of in found]
        rankings += [f.filter(F.col("alt_no") == number) for number in (1, 2) for f in found]
    fused = stored(reciprocal_rank_fusion(rankings), "fused")
    scored = stored(adjust(fused, corpus, queries, now, by_words, known), "adjusted") if priors else fused.select("query_id", "id", "fused", F.col("fused").alias("adjusted"))
    order = Window.partitionBy("query_id").orderBy(F.desc("adjusted"), "id")
    pools = scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= pool)
    pools = pools.join(corpus.select("id", "vector"), "id").join(queries.select("query_id", F.col("vector").alias("query_vector")), "query_id")
    picked = mmr(pools.select("query_id", "place", "id", "vector", "query_vector"), k)
    return picked.join(scored.select("query_id", "id", F.round("adjusted", 6).alias("score")), ["query_id", "id"])


def pack_budget(rows: DataFrame, key: str, order: list, tokens, budget: int, force_first: bool = False) -> DataFrame:
    """The longest prefix of each group whose token sum stays within the budget; with ``force_first`` at least one row.

    Rows of a token or more beyond the first ``budget`` + 1 of their group can't be in it: they are cut in the tasks, before the shuffle.
    """
    place = Window.partitionBy(key).orderBy(*order)
    heavy = rows.filter(tokens > 0).withColumn("place", F.row_number().over(place)).filter(F.col("place") <= budget + 1).drop("place")
    rows = heavy.unionByName(rows.filter(~F.coalesce(tokens > 0, F.lit(False))))
    summed = rows.withColumn("used", F.sum(tokens).over(place.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(place).cast("long"))
    keep = F.col("used") <= budget
    return summed.filter(keep | (F.col("place") == 1) if force_first else keep)
