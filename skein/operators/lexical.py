"""BM25 search over block-max postings that are built, kept and searched where the documents are read.

A piece holds the postings of up to ``PIECE_DOCS`` documents of one partition, its terms sorted, and for each term the
greatest frequency and the shortest length of a document that has it, which bound the term's contribution in the
piece. Nothing is shuffled to build pieces. A search deals its queries into packs of bounded size, which are broadcast a bounded number of bytes
at a time, and each task scores packs against its pieces, block by block: terms that many documents of a piece have are
one product of two small dense matrices, all other terms are added up along their postings. These sums are kept in single precision; what
may reach the best ``k`` so far within their greatest error, and nothing else, is scored in full. A large index is summed in a sample
of its pieces first; what ``k`` documents score there at least is a bar for all tasks: documents that have too little of the frequent terms to reach a
query's bar by them are not multiplied. What a task sends on is its best ``k`` documents of each query that reach the bar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skein.functions import text
from skein.sources.shared import scratch, stored

K1, B = 1.5, 0.75
#: Documents and tokens of a piece; queries and terms of a pack; bytes of packs that are broadcast at once.
PIECE_DOCS, PIECE_TOKENS, PACK_QUERIES, PACK_TERMS, BROADCAST_BYTES = 8192, 1 << 22, 2048, 1_000_000, 32 << 20
DECIMALS = 6
#: Scores this far below the bar may still equal it when rounded.
SLACK = 2e-6
#: Terms that a greater share of a piece's documents have are multiplied as a dense matrix, so many at most.
DENSE_SHARE, DENSE_TERMS = 0.04, 1024
#: Sums (query, document) of a block that are held at once.
BLOCK_SUMS = 1 << 22
#: Queries of a block at most.
BLOCK_QUERIES = 256
#: Indexes of so many pieces are searched in a sample of them first.
LEAST_PIECES = 24
#: A document's mass below this share of the bar stands for what the matrix would add.
LIGHT_SHARE = 0.6


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct (query_id, term) of queries (query_id, text)."""
    return queries.select("query_id", F.explode(F.array_distinct(text.tokenize(F.col("text")))).alias("term"))


def _piece(ids: pa.Array, tokens: pa.ListArray) -> pa.RecordBatch:
    """One piece of documents (ids) and their tokens; documents without tokens count for the statistics."""
    n = len(ids)
    bounds = np.asarray(tokens.offsets)
    size = np.diff(bounds)
    coded = tokens.flatten().dictionary_encode()
    order = np.asarray(pc.sort_indices(coded.dictionary))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    key = place[np.asarray(coded.indices, np.int64)] * n + np.repeat(np.arange(n), size)
    key, tf = np.unique(key, return_counts=True)
    term, at = key // n, key % n
    df = np.bincount(term, minlength=len(order)).astype(np.int32)
    starts = np.cumsum(df) - df
    peak = np.maximum.reduceat(tf, starts) if len(df) else tf
    least = np.minimum.reduceat(size[at], starts) if len(df) else tf
    # Documents stand by what they have of frequent terms, so that a search can leave out the first of them.
    part = np.where(df > DENSE_SHARE * n, np.log((n - df + 0.5) / (df + 0.5) + 1), 0)[term] * tf / (tf + K1 * (1 - B + B * size[at] / max(1.0, size.sum() / max(1, n))))
    by_mass = np.argsort(np.bincount(at, part, n), kind="stable")
    stands = np.empty(n, np.int64)
    stands[by_mass] = np.arange(n)
    order_in = np.argsort(term * n + stands[at])
    at, tf, ids, size = stands[at][order_in], tf[order_in], ids.take(pa.array(by_mass)), size[by_mass]
    packed = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    columns = [
        pa.array([n], pa.int64()), pa.array([int(size.sum())], pa.int64()), one(ids), packed(size, "<i4"), one(coded.dictionary.take(pa.array(order))), one(pa.array(df)),
        packed(at, "<i4"), packed(tf, "<i4"), packed(peak, "<i4"), packed(least, "<i4"),
    ]
    return pa.RecordBatch.from_arrays(columns, ["n", "total", "ids", "lens", "terms", "df", "at", "tf", "peak", "least"])


def pieces(docs: DataFrame) -> DataFrame:
    """Pieces of documents (id, text), in one pass without a shuffle."""
    kind = docs.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = tokens = 0
        for batch in batches:
            bounds = np.asarray(batch.column(1).offsets, np.int64)
            lo = 0
            while lo < batch.num_rows:
                hi = int(np.searchsorted(bounds, bounds[lo] + PIECE_TOKENS - tokens, "right")) - 1
                hi = min(max(hi, lo if held else lo + 1), lo + PIECE_DOCS - count, batch.num_rows)
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
                    count, tokens = count + hi - lo, tokens + int(bounds[hi] - bounds[lo])
                if count == PIECE_DOCS or hi < batch.num_rows:
                    yield made(held)
                    held, count, tokens = [], 0, 0
                lo = hi
        if held:
            yield made(held)

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        tokens = whole.column(1).chunk(0)
        tokens = pa.ListArray.from_arrays(pc.subtract(tokens.offsets, tokens.offsets[0]), tokens.flatten())
        return _piece(whole.column(0).chunk(0), tokens)

    schema = f"n long, total long, ids array<{kind.simpleString()}>, lens binary, terms array<string>, df array<int>, at binary, tf binary, peak binary, least binary"
    tokens = F.coalesce(text.tokenize(F.col("text")), F.array().cast("array<string>"))
    return docs.select("id", tokens.alias("tokens")).mapInArrow(run, schema)


class Piece:
    """A piece in a task: its postings by term, weighted for a corpus of mean length ``mean``."""

    def __init__(self, row: dict, mean: float) -> None:
        number = lambda c: np.frombuffer(row[c].as_py(), "<i4")
        self.n, self.ids, self.terms = row["n"].as_py(), row["ids"].values, row["terms"].values
        self.nameless = np.flatnonzero(np.asarray(self.ids.is_null()))
        df = np.asarray(row["df"].values, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(df)])
        self.at = number("at").astype(np.int64)
        #: Where the postings stand by document, and their terms in that order.
        self.by_doc = np.argsort(self.at.astype(np.min_scalar_type(max(1, self.n))), kind="stable")
        self.doc_terms = np.repeat(np.arange(len(df), dtype=np.int32), df)[self.by_doc]
        self.doc_starts = np.concatenate([[0], np.cumsum(np.bincount(self.at, minlength=self.n))])
        self.marked = np.zeros(len(df), bool)
        size = K1 * (1 - B + B * number("lens") / mean)
        saturated = lambda tf, size: tf * (K1 + 1) / (tf + size)
        self.weight = saturated(number("tf"), size[self.at])
        self.bound = saturated(number("peak"), K1 * (1 - B + B * number("least") / mean))
        often = np.flatnonzero(df > DENSE_SHARE * self.n)
        self.often = np.sort(often[np.argsort(-df[often], kind="stable")[:DENSE_TERMS]])
        self.df, self.column, self.value = df, np.full(len(df), -1), np.zeros(len(df))
        self.column[self.often] = np.arange(len(self.often))
        #: A row a document, so that some documents alone can be multiplied.
        self.dense = np.zeros((self.n, len(self.often)), np.float32)
        for c, t in enumerate(self.often.tolist()):
            lo, hi = self.starts[t], self.starts[t + 1]
            self.dense[self.at[lo:hi], c] = self.weight[lo:hi]
        self.postings = np.empty(2 * len(self.at), np.uint32)
        self.postings[1::2] = self.at
        self.steps = np.arange(max(1, self.n) * 4)

    def search(self, terms: np.ndarray, idf: np.ndarray, k: int, bar: float) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the best ``k`` of a query, and their scores; ``bar``: what ``k`` others have already."""
        for _, docs, scores in self.search_block(np.array([0, len(terms)]), terms, idf, k, np.array([bar])):
            return docs, scores
        return np.empty(0, np.int64), np.empty(0)

    def search_block(self, bounds: np.ndarray, terms: np.ndarray, idf: np.ndarray, k: int, bars: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The same for several queries, whose terms lie between ``bounds``: (query, documents, scores) of those that find some.

        What the terms of the matrix add to a document is at most ``mass``, whatever the query, so documents of little mass
        are multiplied only with queries of low bars; for others the mass stands in the sum, and what then reaches the bar is scored in full.
        """
        for block, queries, least, heavy, sums, error in self._blocks(bounds, terms, idf, bars):
            reached = sums >= least[:, None]
            for r in np.flatnonzero(np.count_nonzero(reached, axis=1) > k).tolist():
                known = sums[r, heavy:]
                if len(known) >= k:
                    local = float(np.partition(known, len(known) - k)[len(known) - k]) / (1 + error)
                    reached[r] = sums[r] >= max(least[r], (local - SLACK) * (1 - error))
            row, docs = np.divmod(np.flatnonzero(reached), self.n)
            ends = np.searchsorted(row, np.arange(len(block) + 1))
            for r in np.flatnonzero(np.diff(ends)).tolist():
                found = docs[ends[r] : ends[r + 1]]
                yield int(block[r]), found, self._scores(found, queries[r])

    def least_best(self, bounds: np.ndarray, terms: np.ndarray, idf: np.ndarray, k: int, held: np.ndarray) -> None:
        """Puts into ``held`` (a row a query) what the best ``k`` documents score at least; none is scored in full."""
        for block, _, _, _, sums, error in self._blocks(bounds, terms, idf, np.zeros(len(bounds) - 1)):
            best = np.partition(sums, self.n - k, axis=1)[:, self.n - k :] if self.n > k else sums
            both = np.concatenate([held[block], best / (1 + error) - SLACK], axis=1)
            held[block] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]

    def _blocks(self, bounds: np.ndarray, terms: np.ndarray, idf: np.ndarray, bars: np.ndarray) -> Iterator[tuple]:
        """Blocks of queries that may find something: their numbers, terms, least sums, and sums with all documents up to a relative error.

        Sums of the documents before ``heavy`` are upper bounds.
        """
        total = np.concatenate([[0.0], np.cumsum(idf * self.bound[terms])])
        reach = total[bounds[1:]] - total[bounds[:-1]]
        asked = np.flatnonzero((np.diff(bounds) > 0) & (reach * (1 + 1e-9) + SLACK >= bars))
        asked = asked[np.argsort(bars[asked], kind="stable")]
        # Greatest relative error of a sum: all parts are positive, and each step rounds once.
        error = (len(self.often) + int(np.diff(bounds).max(initial=0)) + 8) * 6e-8
        self.value[:] = 0.0
        self.value[terms] = idf  # a term's idf is the same in all queries
        valued = self.weight * np.repeat(self.value, self.df)
        # Document and value of a posting lie side by side: a search fetches both at once.
        self.postings[0::2] = valued.astype(np.float32).view(np.uint32)
        self.doc_values = valued[self.by_doc]
        factor = self.value[self.often].astype(np.float32)
        mass = self.dense @ factor * (1 + error)
        most = np.maximum.accumulate(mass)
        step = max(1, min(BLOCK_QUERIES, BLOCK_SUMS // max(1, self.n)))
        for lo in range(0, len(asked), step):
            block = asked[lo : lo + step]
            queries = [terms[bounds[q] : bounds[q + 1]] for q in block.tolist()]
            least = np.maximum((bars[block] - SLACK) * (1 - error), 1e-30)
            sums = self._sums(queries)
            often = np.zeros((len(block), len(self.often)), np.float32)
            for r, query in enumerate(queries):
                column = self.column[query]
                column = column[column >= 0]
                often[r, column] = factor[column]
            # A document whose mass is near the bar would reach it by little else.
            heavy = int(np.searchsorted(most, LIGHT_SHARE * least[0]))
            sums[:, :heavy] += mass[:heavy]
            sums[:, heavy:] += often @ self.dense[heavy:].T
            sums[:, self.nameless] = 0
            yield block, queries, least, heavy, sums, error

    def _sums(self, queries: list[np.ndarray]) -> np.ndarray:
        """Sums of queries and all documents over the terms that the matrix does not hold, in single precision."""
        sums = np.zeros((len(queries), self.n), np.float32)
        for r, terms in enumerate(queries):
            terms = terms[self.column[terms] < 0]
            size = self.df[terms]
            ends = np.cumsum(size)
            if not len(terms):
                continue
            spot = np.repeat(self.starts[terms] - ends + size, size)
            spot += self.steps[: len(spot)] if len(spot) <= len(self.steps) else np.arange(len(spot))
            found = np.take(self.postings.view(np.uint64), spot, mode="clip").view(np.uint32)
            np.add.at(sums[r], found[1::2].astype(np.intp), found[0::2].copy().view(np.float32))
        return sums

    def _scores(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Full scores, terms always added in their sorted order, so that they don't depend on the piece."""
        self.marked[terms] = True
        spans = [slice(lo, hi) for lo, hi in zip(self.doc_starts[docs].tolist(), self.doc_starts[docs + 1].tolist(), strict=True)]
        row = np.repeat(np.arange(len(docs)), self.doc_starts[docs + 1] - self.doc_starts[docs])
        parts = self.marked[np.concatenate([self.doc_terms[x] for x in spans])] * np.concatenate([self.doc_values[x] for x in spans])
        self.marked[terms] = False
        return np.bincount(row, parts, len(docs))

    def shared(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """How many of the terms each document has."""
        self.marked[terms] = True
        found = np.array([np.count_nonzero(self.marked[self.doc_terms[self.doc_starts[d] : self.doc_starts[d + 1]]]) for d in docs.tolist()])
        self.marked[terms] = False
        return found


class Best:
    """The best ``k`` of each query of a pack that a task has seen: equal scores by the smaller id."""

    def __init__(self, n: int, k: int, bars: np.ndarray | None = None) -> None:
        self.k = k
        self.found: list[list[tuple[float, object, int]]] = [[] for _ in range(n)]
        #: What ``k`` documents of each query have already, here or in other tasks.
        self.bars = np.zeros(n) if bars is None else np.array(bars, float)

    def add(self, q: int, ids: list, scores: np.ndarray, shared: np.ndarray) -> None:
        bar = self.bars[q]
        rows = [(-s, i, n) for s, i, n in zip(np.round(scores, DECIMALS).tolist(), ids, shared.tolist(), strict=True) if s > 0 and s >= bar and i is not None]
        if rows:
            self.found[q] = held = sorted(self.found[q] + rows)[: self.k]
            if len(held) == self.k:
                self.bars[q] = max(bar, -held[-1][0])


class Asked:
    """The queries of packs, over one vocabulary."""

    def __init__(self, packs: list[dict], k: int) -> None:
        number = lambda c, t: [np.frombuffer(x[c].as_py(), t) for x in packs]
        codes, starts, idf = number("codes", "<i4"), number("q_starts", "<i8"), number("idf", "<f8")
        words = pa.concat_arrays([x["vocab"].values for x in packs]).dictionary_encode()
        place, self.vocab = np.asarray(words.indices, np.int64), words.dictionary
        shift = np.cumsum([0] + [len(x) for x in idf])
        self.codes = np.concatenate([place[c + n] for c, n in zip(codes, shift.tolist(), strict=False)])
        shift = np.cumsum([0] + [len(x) for x in codes])
        self.starts = np.concatenate([x[:-1] + n for x, n in zip(starts, shift.tolist(), strict=False)] + [shift[-1:]])
        self.idf = np.empty(len(self.vocab))
        self.idf[place] = np.concatenate(idf)
        self.ids = [i for x in packs for i in x["query_ids"].values.to_pylist()]
        self.least = np.zeros((len(self.ids), k), np.float32)
        self.top = Best(len(self.ids), k, np.concatenate(number("bars", "<f8")) if "bars" in packs[0] else None)

    def meet(self, piece: Piece, k: int, rough: bool) -> None:
        where = np.asarray(pc.fill_null(pc.index_in(self.vocab, value_set=piece.terms), -1), np.int64)
        known = where[self.codes] >= 0
        bounds = np.concatenate([[0], np.cumsum(known)])[self.starts]
        codes = self.codes[known]
        if rough:
            return piece.least_best(bounds, where[codes], self.idf[codes], k, self.least)
        for q, docs, scores in piece.search_block(bounds, where[codes], self.idf[codes], k, self.top.bars.copy()):
            kept = np.round(scores, DECIMALS) >= self.top.bars[q]
            if kept.any():
                docs = docs[kept]
                self.top.add(q, piece.ids.take(pa.array(docs)).to_pylist(), scores[kept], piece.shared(docs, where[codes[bounds[q] : bounds[q + 1]]]))


def _searched(k: int, mean: float, query_kind, id_kind, rough: bool = False):
    """Pieces joined with packs become each task's best rows. ``packs``: the packs of a turn, which stand in a task's first row alone.

    ``rough``: what the best score at least, without ids.
    """
    schema = pa.schema([("query_id", query_kind), ("id", id_kind), ("score", pa.float64()), ("shared", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Asked] = {}
        last, piece = None, None
        for batch in batches:
            names = batch.schema.names
            for r in range(batch.num_rows):
                row = {c: batch.column(i)[r] for i, c in enumerate(names)}
                key = (row["at"].as_py(), row["lens"].as_py())
                if key != last:
                    last, piece = key, Piece(row, mean)
                pack = -1 if "packs" in row else row["pack"].as_py()
                if pack not in best:
                    held = row["packs"].values.flatten() if pack < 0 else None
                    fields = [] if pack >= 0 else [f.name for f in row["packs"].type.value_type]
                    best[pack] = Asked([row] if held is None else [{c: held[i][j] for i, c in enumerate(fields)} for j in range(len(held[0]))], k)
                best[pack].meet(piece, k, rough)
        for asked in best.values():
            if rough:
                q, place = np.nonzero(asked.least > 0)
                rows = [(asked.ids[a], None, s, 0) for a, s in zip(q.tolist(), asked.least[q, place].tolist(), strict=True)]
            else:
                rows = [(a, i, -s, n) for a, held in zip(asked.ids, asked.top.found, strict=True) for s, i, n in held]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _packed(terms: DataFrame) -> DataFrame:
    """(query_id, term, idf, pack) as one row a pack."""
    kind = terms.schema["query_id"].dataType
    arrow = to_arrow_type(kind)

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("query_id", "ascending"), ("term", "ascending")])
        words, asked = table.column("term").combine_chunks().dictionary_encode(), table.column("query_id").combine_chunks().dictionary_encode()
        idf = np.empty(len(words.dictionary))
        idf[np.asarray(words.indices)] = np.asarray(table.column("idf"))
        starts = np.searchsorted(np.asarray(asked.indices), np.arange(len(asked.dictionary) + 1))
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        packed = lambda x, t: pa.array([x.astype(t).tobytes()], pa.binary())
        return pa.table({
            "pack": table.column("pack").slice(0, 1), "query_ids": one(asked.dictionary.cast(arrow)), "q_starts": packed(starts, "<i8"), "vocab": one(words.dictionary),
            "codes": packed(np.asarray(words.indices), "<i4"), "idf": packed(idf, "<f8"),
        })

    schema = f"pack long, query_ids array<{kind.simpleString()}>, q_starts binary, vocab array<string>, codes binary, idf binary"
    return terms.groupBy("pack").applyInArrow(work, schema)


def _barred(packed: DataFrame, bars: DataFrame) -> DataFrame:
    """Packs with the bars (query_id, bar) of their queries; 0 where there is none."""
    held = packed.select("pack", F.posexplode("query_ids").alias("at", "query_id")).join(bars, "query_id", "left")
    held = held.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("bar", F.lit(0.0)).alias("bar")))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.asarray(x.values, float).astype("<f8").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["pack", "bars"])

    return packed.join(held.select("pack", F.col("rows.bar").alias("bars")).mapInArrow(run, "pack long, bars binary"), "pack")


class LexicalIndex:
    """Block-max postings of a corpus, in a folder; statistics are those of the whole corpus."""

    def __init__(self, held: DataFrame) -> None:
        self.pieces = held
        stats = held.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.count("*").alias("pieces")).first()
        self.n, self.n_pieces = float(stats["n"] or 0), stats["pieces"]
        self.mean = max(1.0, (stats["total"] or 0) / max(1.0, self.n))

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None) -> LexicalIndex:
        """Index documents (id, text) into ``path``, or a fresh path in the shared folder."""
        spark = docs.sparkSession
        path = path or scratch(spark, "lexical-index")
        made = pieces(docs)
        made.write.parquet(path)
        return cls(spark.read.schema(made.schema).parquet(path))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LexicalIndex:
        return cls(spark.read.parquet(path))

    def frequencies(self, wanted: DataFrame | None = None) -> DataFrame:
        """term, df; of the wanted terms (term) only, where given."""
        rows = self.pieces.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
        rows = rows if wanted is None else rows.join(wanted.select("term").distinct(), "term", "left_semi")
        return rows.groupBy("term").agg(F.sum("df").alias("df"))

    def search(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """query_id, id, score, rank of queries (query_id, text): positive scores, best ``k``; ties to smaller ids."""
        return self.search_shared(queries, k)[0].drop("shared")

    def search_shared(self, queries: DataFrame, k: int = 20) -> tuple[DataFrame, DataFrame]:
        """``search`` with ``shared``, the number of distinct terms that query and document share; and the queries (query_id) of which any document has a term."""
        df = F.col("df")

        def top(found: DataFrame) -> DataFrame:
            ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
            return ranked.filter(F.col("rank") <= k)

        terms = stored(query_terms(queries).distinct(), "query-terms")
        idf = F.log((F.lit(self.n) - df + 0.5) / (df + 0.5) + 1.0).alias("idf")
        size = terms.agg(F.count("*").alias("terms"), F.count_distinct("query_id").alias("queries")).first()
        packs = max(1, -(-size["queries"] // PACK_QUERIES), -(-size["terms"] // PACK_TERMS))
        terms = terms.join(self.frequencies(terms), "term").select("query_id", "term", idf, F.pmod(F.xxhash64("query_id"), F.lit(packs)).alias("pack"))
        packed = stored(_packed(terms), "query-packs")
        sized = packed.agg(F.sum(F.length("codes") + F.length("idf") + 24 * F.size("vocab")).alias("bytes")).first()["bytes"] or 0
        turns = -(-sized // BROADCAST_BYTES) or 1
        kinds = to_arrow_type(packed.schema["query_ids"].dataType.elementType), to_arrow_type(self.pieces.schema["ids"].dataType.elementType)
        pieces = self.pieces.select("n", "ids", "lens", "terms", "df", "at", "tf", "peak", "least")
        if self.n_pieces >= LEAST_PIECES:
            # What the best of a sample of the pieces score at least is a bar for all documents.
            share = round((self.n_pieces / 2) ** 0.5)
            chosen = F.pmod(F.xxhash64("n", "peak"), F.lit(share)) == 0
            rough = top(self._found(pieces.filter(chosen), packed, turns, k, kinds, True))
            bars = rough.filter(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
            packed = stored(_barred(packed, bars), "query-packs")
        return top(self._found(pieces, packed, turns, k, kinds)), packed.select(F.explode("query_ids").alias("query_id"))

    def _found(self, pieces: DataFrame, packed: DataFrame, turns: int, k: int, kinds: tuple, rough: bool = False) -> DataFrame:
        """query_id, id, score: the best rows of each task, packs broadcast in turns."""
        schema = f"query_id {packed.schema['query_ids'].dataType.elementType.simpleString()}, id {pieces.schema['ids'].dataType.elementType.simpleString()}, score double, shared int"
        found = None
        for turn in range(turns):
            asked = packed.filter(F.pmod(F.xxhash64("pack"), F.lit(turns)) == turn).agg(F.collect_list(F.struct(*packed.columns)).alias("packs")).filter(F.size("packs") > 0)
            # All rows of a task have the same packs: the first alone takes them to Python.
            rows = pieces.withColumn("row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).join(F.broadcast(asked))
            one = rows.select(*pieces.columns, F.when(F.col("row") == 0, F.col("packs")).alias("packs")).mapInArrow(_searched(k, self.mean, *kinds, rough), schema)
            found = one if found is None else found.union(one)
        return found
