"""Exact top-k inner-product search with paged M-trees, best first.

Vectors become integer vectors, floor(1024 x). One more coordinate, the root of (largest squared norm - own squared
norm), makes the largest inner product the smallest Euclidean distance, so that a metric tree applies. The root page
holds routing objects chosen by hash; each row goes to the cell of its nearest one, and the cell keeps its covering
radius. Cells of about ``cell_rows`` rows are M-trees in pages of at most ``PAGE`` entries, stored as a table: routing
entries hold an object, its covering radius, its distance to the parent's object and a child page, leaf entries an
object, its distance to the parent's object and its id. Cells that grow too large (many equal vectors) are several
trees.

A query first visits the cell nearest to it, under a bound from a sample of candidates (real ones, so that the bound is
safe); then, under the bound that visit gave, only the cells whose ball it reaches. Inside a tree, pages are visited by
their least possible distance, and the triangle inequality over stored parent distances and radii discards entries
before their distances are computed. Results are exact, equal scores go to smaller ids, and no candidate is skipped
unless a bound proves it.

Vectors that are null or hold null, NaN or infinite components take no part, nor do rows without vec_id. Shorter
vectors count as padded with zeros. Rows equal in id and vector count once; a query's own id is no candidate. Inner
products must fit into 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import map_batches, read, stored

SCALE = 1024
PAGE = 64
#: Rows of a cell, and cells at most (their routing objects travel with the tasks: 16384 vectors); beyond, cells grow.
CELL_ROWS, MOST_CELLS = 4096, 16384
#: Queries that visit a tree together.
QUERY_BLOCK = 1024
#: Sampled candidates for the first bound.
SEED_ROWS = 2048


def integer_vectors(rows: DataFrame) -> DataFrame:
    """vec_id and v (array<long>) of the rows that take part."""
    x = F.col("embedding")
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))).cast("long"))
    return rows.filter(F.col("vec_id").isNotNull() & sound).select("vec_id", v.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), width), np.int64)
    flat = np.asarray(column.flatten(), np.int64)
    sizes = np.diff(np.asarray(column.offsets, np.int64))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _lift(v: np.ndarray, most: int) -> np.ndarray:
    """Vectors with the coordinate that makes all norms equal."""
    f = v.astype(np.float64)
    return np.hstack([f, np.sqrt(np.maximum(0.0, most - (f * f).sum(axis=1)))[:, None]])


def build_pages(ids: np.ndarray, v: np.ndarray, most: int, seed: int = 7) -> list[dict]:
    """Pages of one M-tree, the root first. Bulk load: objects go to their nearest routing object, level by level."""
    lifted = _lift(v, most)
    rng = np.random.default_rng(seed)
    pages: list[dict] = []

    def add(members: np.ndarray, parent: int | None) -> tuple[int, float]:
        """Page number and covering radius of a subtree around the object ``parent``."""
        number = len(pages)
        pages.append({})
        far = np.linalg.norm(lifted[members] - lifted[parent], axis=1) if parent is not None else np.zeros(len(members))
        if len(members) <= PAGE:
            pages[number] = {"leaf": True, "ids": ids[members], "v": v[members], "to_parent": far, "radius": np.zeros(len(members))}
            return number, float(far.max(initial=0.0))
        fan = min(PAGE, -(-len(members) // (PAGE // 2)))
        picks = rng.permutation(members)[:fan]
        gap = ((lifted[members, None, :] - lifted[None, picks, :]) ** 2).sum(axis=2) if len(members) * fan <= 65536 else np.stack(
            [((lifted[members] - lifted[p]) ** 2).sum(axis=1) for p in picks], axis=1)
        owner = gap.argmin(axis=1)
        if np.bincount(owner, minlength=fan).max() > 0.9 * len(members):  # many equal objects: deal them evenly
            owner = np.arange(len(members)) % fan
        entries = []
        for k in range(fan):
            own = members[owner == k]
            if len(own):
                child, radius = add(own, int(picks[k]))
                entries.append((child, picks[k], radius))
        objects = np.array([p for _, p, _ in entries])
        to_parent = np.linalg.norm(lifted[objects] - lifted[parent], axis=1) if parent is not None else np.zeros(len(objects))
        pages[number] = {
            "leaf": False, "ids": np.array([c for c, _, _ in entries], np.int64), "v": v[objects], "to_parent": to_parent,
            "radius": np.array([r for _, _, r in entries]),
        }
        return number, float(far.max(initial=0.0))

    if len(ids):
        add(np.arange(len(ids)), None)
    return pages


class Tree:
    """A stored M-tree, ready for searches."""

    def __init__(self, pages: list[dict], most: int) -> None:
        self.pages = pages
        self.most = most
        for p in pages:
            p["lifted"] = _lift(p["v"], most)
        self.computed = 0

    def search(self, q: np.ndarray, own: int, k: int, floor: float) -> list[tuple[int, int]]:
        """The best (score, id) pairs for a query among those that score at least ``floor``; ties to smaller ids."""
        if not self.pages:
            return []
        target = np.append(q.astype(np.float64), 0.0)
        total = float(target @ target) + self.most
        slack = 1e-9 * total + 1e-6
        best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first
        bar = floor

        def reach(score: float) -> float:
            """The distance beyond which scores are below ``score``."""
            return float(np.sqrt(max(0.0, total - 2 * score + slack))) + 1e-7

        limit = reach(bar) if bar > -np.inf else np.inf
        queue: list[tuple[float, int, float]] = [(0.0, 0, -1.0)]
        while queue:
            least, number, to_object = heapq.heappop(queue)
            if least > limit:
                break
            page = self.pages[number]
            lifted = page["lifted"]
            if to_object >= 0 and limit < np.inf:
                open_ = np.flatnonzero(np.abs(to_object - page["to_parent"]) - page["radius"] <= limit)
                if len(open_) == 0:
                    continue
            else:
                open_ = np.arange(len(lifted))
            self.computed += len(open_)
            if page["leaf"]:
                scores = page["v"][open_] @ q
                for i in np.flatnonzero(scores >= bar) if bar > -np.inf else range(len(open_)):
                    vec = int(page["ids"][open_[i]])
                    if vec == own:
                        continue
                    item = (int(scores[i]), -vec)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                if len(best) == k and best[0][0] > bar:
                    bar = best[0][0]
                    limit = reach(bar)
                continue
            d = np.sqrt(((lifted[open_] - target) ** 2).sum(axis=1))
            low = np.maximum(0.0, d - page["radius"][open_])
            for i in np.flatnonzero(low <= limit):
                heapq.heappush(queue, (float(low[i]), int(page["ids"][open_[i]]), float(d[i])))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


PAGES = "cell int, part int, page int, leaf boolean, ids array<long>, v binary, to_parent binary, radius binary"
FOUND = "query_id long, query_key long, vec_id long, score long"


class Cells:
    """The root page: routing objects, and how far a query is from them."""

    def __init__(self, objects: np.ndarray, most: int) -> None:
        self.objects, self.most = objects, most
        self.lifted = _lift(objects, most)

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's cell and its distance from the cell's object."""
        lifted = _lift(v, self.most)
        cell = np.concatenate([(lifted[lo : lo + 256] @ self.lifted.T).argmax(axis=1) for lo in range(0, len(v), 256)] or [np.empty(0, np.int64)])
        return cell, np.linalg.norm(lifted - self.lifted[cell], axis=1)

    def distances(self, q: np.ndarray) -> np.ndarray:
        total = float(q.astype(np.float64) @ q) + self.most
        return np.sqrt(np.maximum(0.0, total - 2.0 * (self.objects @ q)))

    def reached(self, q: np.ndarray, floor: float, radii: np.ndarray) -> np.ndarray:
        """The cells that may hold a score of at least ``floor``."""
        if floor == -np.inf:
            return np.flatnonzero(radii >= 0)
        total = float(q.astype(np.float64) @ q) + self.most
        limit = np.sqrt(max(0.0, total - 2 * floor + 1e-9 * total + 1e-6)) + 1e-6
        return np.flatnonzero((radii >= 0) & (self.distances(q) - radii <= limit))


def build_trees(placed: DataFrame, width: int, most: int) -> DataFrame:
    """The pages of all trees of ``placed`` (cell, part, vec_id, v)."""

    def build(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("vec_id"), np.int64)
        v = _matrix(table.column("v"), width)
        order = np.lexsort((*v.T[::-1], ids))
        pages = build_pages(ids[order], v[order], most)
        n = len(pages)
        return pa.table(
            {
                "cell": pa.array([table.column("cell")[0].as_py()] * n, pa.int32()),
                "part": pa.array([table.column("part")[0].as_py()] * n, pa.int32()),
                "page": pa.array(range(n), pa.int32()),
                "leaf": pa.array([p["leaf"] for p in pages]),
                "ids": pa.array([p["ids"].tolist() for p in pages], pa.list_(pa.int64())),
                "v": pa.array([p["v"].astype("<i8").tobytes() for p in pages], pa.binary()),
                "to_parent": pa.array([p["to_parent"].astype("<f8").tobytes() for p in pages], pa.binary()),
                "radius": pa.array([p["radius"].astype("<f8").tobytes() for p in pages], pa.binary()),
            }
        )

    return placed.groupBy("cell", "part").applyInArrow(build, PAGES)


def _place(vectors: DataFrame, cells: Cells, width: int) -> DataFrame:
    """(cell, far, vec_id, v): each row in the cell of its nearest routing object."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = cells.nearest(_matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(far), *batch.columns], ["cell", "far", "vec_id", "v"])

    return map_batches(vectors.select("vec_id", "v"), run, "cell int, far double, vec_id long, v array<long>")


def _routes(asked: DataFrame, cells: Cells, radii: np.ndarray, width: int, first: bool) -> DataFrame:
    """(cell, vec_id, query_key, v, bar): the cell nearest to each query, or else the other cells that its bar reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cell = [], []
            for i, (q, bar) in enumerate(zip(_matrix(batch.column(2), width), batch.column(3).to_pylist(), strict=True)):
                near = int(np.where(radii >= 0, cells.distances(q), np.inf).argmin())
                to = np.array([near]) if first else np.setdiff1d(cells.reached(q, -np.inf if bar is None else bar, radii), [near])
                row.append(np.full(len(to), i))
                cell.append(to)
            if row:
                out = batch.take(pa.array(np.concatenate(row)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell).astype(np.int32)), *out.columns], ["cell", "vec_id", "query_key", "v", "bar"])

    return map_batches(asked.select("vec_id", "query_key", "v", "bar"), run, "cell int, vec_id long, query_key long, v array<long>, bar double")


def _visit(routes: DataFrame, parts: DataFrame, pages: DataFrame, k: int, width: int, most: int) -> DataFrame:
    """The best of each query in each tree it visits: query_id, query_key, vec_id, score."""
    routes = stored(routes, "mtree-routes")
    blocks = routes.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(QUERY_BLOCK)).cast("long").alias("blocks"))
    dealt = routes.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id", "query_key"), F.col("blocks")))
    dealt = dealt.groupBy("cell", "block").agg(F.collect_list(F.struct("vec_id", "query_key", "v", "bar")).alias("q"))
    dealt = dealt.join(parts.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "cell")
    # A tree's pages travel together: they hold about a cell's rows.
    packed = pages.groupBy("cell", "part").agg(F.sort_array(F.collect_list(F.struct("page", "leaf", "ids", "v", "to_parent", "radius"))).alias("pages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                tree = Tree(
                    [
                        {
                            "leaf": p["leaf"], "ids": np.array(p["ids"], np.int64), "v": np.frombuffer(p["v"], "<i8").reshape(-1, width),
                            "to_parent": np.frombuffer(p["to_parent"], "<f8"), "radius": np.frombuffer(p["radius"], "<f8"),
                        }
                        for p in batch.column(1)[r].as_py()
                    ],
                    most,
                )
                out = []
                for q in batch.column(0)[r].as_py():
                    v = np.zeros(width, np.int64)
                    v[: len(q["v"])] = q["v"]
                    floor = -np.inf if q["bar"] is None else q["bar"]
                    out += [(q["vec_id"], q["query_key"], i, s) for s, i in tree.search(v, q["vec_id"], k, floor)]
                columns = list(zip(*out, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "query_key", "vec_id", "score"])

    return map_batches(dealt.join(packed, ["cell", "part"]).select("q", "pages"), run, FOUND)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, cell_rows: int = CELL_ROWS, seed_rows: int = SEED_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best inner products among ``rows`` (both vec_id, embedding)."""
    vectors = stored(integer_vectors(rows).distinct(), "mtree-vectors")
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c * c)
    asked = integer_vectors(queries).distinct()
    about = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(norm).alias("most")).first()
    width = max(about["width"] or 1, asked.agg(F.max(F.size("v")).alias("width")).first()["width"] or 1)
    n, most = about["n"], int(about["most"] or 0)

    # A sample by hash, of bounded size: the routing objects, and the candidates of the first bound.
    count = max(1, min(MOST_CELLS, -(-n // cell_rows)))
    take = max(seed_rows, count)
    order = F.xxhash64(F.lit("sample"), "vec_id", "v")
    share = min(1.0, 2 * take / max(1, n))
    sample = vectors.filter(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(order, "vec_id").limit(take).toArrow()
    seed_ids, seed_v = np.asarray(sample.column("vec_id"), np.int64), _matrix(sample.column("v"), width)
    if n and len(seed_ids) == 0:  # a table of a few rows whose hashes all lie outside
        few = vectors.limit(1).toArrow()
        seed_ids, seed_v = np.asarray(few.column("vec_id"), np.int64), _matrix(few.column("v"), width)
    cells = Cells(np.unique(seed_v[:count], axis=0) if n else np.zeros((1, width), np.int64), most)

    placed = stored(_place(vectors, cells, width), "mtree-placed")
    parts = placed.groupBy("cell").agg(F.max("far").alias("far"), F.ceil(F.count("*") / F.lit(2 * max(cell_rows, n // count))).cast("int").alias("parts"))
    parts = stored(parts, "mtree-cells")
    radii = np.full(len(cells.objects), -1.0)
    for r in parts.collect():  # one row for each routing object
        radii[r.cell] = r.far + 1e-6
    placed = placed.join(F.broadcast(parts.select("cell", "parts")), "cell")
    placed = placed.select("cell", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int").alias("part"), "vec_id", "v")
    pages = stored(build_trees(placed, width, most), "mtree-pages")

    def bars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), width)
            key = (v * np.arange(1, 2 * width, 2)).sum(axis=1)  # tells apart queries that share an id
            bar = []
            for own, q in zip(batch.column(0).to_pylist(), v, strict=True):
                scores = (seed_v @ q)[seed_ids != own]
                bar.append(float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key), batch.column(1), pa.array(bar, pa.float64())], ["vec_id", "query_key", "v", "bar"])

    asked = stored(map_batches(asked.select("vec_id", "v"), bars, "vec_id long, query_key long, v array<long>, bar double"), "mtree-asked")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    near = stored(_visit(_routes(asked, cells, radii, width, True), parts, pages, k, width, most), "mtree-near")
    # The k-th score so far bounds what the other cells must offer.
    kth = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k)
    kth = kth.select(F.col("query_id").alias("vec_id"), "query_key", F.col("score").cast("double").alias("kth"))
    closer = asked.join(kth, ["vec_id", "query_key"], "left").withColumn("bar", F.greatest("bar", "kth"))
    rest = _visit(_routes(closer, cells, radii, width, False), parts, pages, k, width, most)
    found = near.union(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def op5_mtree_topk(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter(F.col("vec_id") % 100 == 0))
