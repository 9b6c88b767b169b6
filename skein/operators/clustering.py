"""Session vectors, greedy threshold clustering, grouping and continuity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skein.functions import vectors as V
from skein.sources.shared import stored

THRESHOLD = 0.55
#: Vectors that are measured at once while clusters grow.
BLOCK = 256
#: Vectors of a piece, vectors that a task holds while packing, and bytes of pieces that are broadcast at once.
PIECE, HELD, BROADCAST_BYTES = 512, 65_536, 32 << 20


def mean_vectors(rows: DataFrame, key: str) -> DataFrame:
    """key, vector: mean-pooled, unit-length vectors of rows (key, vector); null where sizes differ.

    Components are summed by position with partial aggregation, so no group is gathered as rows.
    """
    sizes = rows.filter("vector is not null").groupBy(key).agg(F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi"))
    parts = rows.filter("vector is not null").select(key, F.posexplode(V.doubles(F.col("vector"))).alias("pos", "x"))
    sums = parts.groupBy(key, "pos").agg(F.avg("x").alias("x"))
    whole = sums.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))
    joined = whole.join(sizes, key)
    return joined.select(key, F.when(F.col("lo") == F.col("hi"), V.normalise(F.col("mean"))).alias("vector"))


class GreedyClusters:
    """Clusters of vectors in a given order: each joins the last cluster of greatest cosine at or above the threshold, or founds one.

    A block of vectors is measured against all centres at once; while it is dealt, only centres that it has moved or founded itself are
    measured anew. Memory holds the clusters and a block, not what was dealt before.
    """

    def __init__(self, threshold: float = THRESHOLD) -> None:
        self.threshold, self.n = threshold, 0
        self.sums = self.centres = np.empty((0, 0))

    def add(self, block: np.ndarray) -> list[int]:
        size = block.shape[1]
        if self.centres.shape[1] != size:
            if self.n:
                raise ValueError("vectors of a group have one length")
            self.sums, self.centres = np.zeros((16, size)), np.zeros((16, size))
        known = self.n
        measured = block @ self.centres[:known].T
        moved: list[int] = []
        out = []
        for v, cosine in zip(block, measured, strict=True):
            if moved:
                cosine[moved] = self.centres[moved] @ v
            cosine = np.concatenate([cosine, self.centres[known : self.n] @ v])
            best = -1
            if self.n and (top := cosine.max()) >= self.threshold:
                best = int(np.flatnonzero(cosine == top)[-1])
            if best < 0:
                best = self.n
                self.n += 1
                if self.n > len(self.sums):
                    self.sums, self.centres = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.centres))
            elif best < known and best not in moved:
                moved.append(best)
            self.sums[best] += v
            norm = np.linalg.norm(self.sums[best])
            self.centres[best] = self.sums[best] / norm if norm > V.EPSILON else self.sums[best]
            out.append(best)
        return out


def cluster(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, cluster of rows (grp, id, vector), in the order of the ids as text; rows without a vector are in no cluster.

    The order is sequential by definition: a group passes through one task, as a stream, of which the clusters alone are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, clusters = None, None
        for batch in batches:
            groups, vectors = batch.column(0).to_pylist(), batch.column(2)
            lo = 0
            while lo < len(groups):
                hi = lo + 1
                while hi < min(len(groups), lo + BLOCK) and groups[hi] == groups[lo]:
                    hi += 1
                if clusters is None or groups[lo] != last:
                    last, clusters = groups[lo], GreedyClusters(threshold)
                part = vectors.slice(lo, hi - lo)
                size = len(part[0])
                if pa.compute.any(pa.compute.not_equal(part.value_lengths(), size)).as_py():
                    raise ValueError("vectors of a group have one length")
                found = clusters.add(np.asarray(part.flatten(), float).reshape(hi - lo, size))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(found, pa.int64())], ["id", "cluster"])
                lo = hi

    order = F.col("id").cast("string")
    dealt = rows.filter("vector is not null").select("grp", "id", "vector").repartition("grp").sortWithinPartitions("grp", order)
    return dealt.mapInArrow(run, "id long, cluster long")


def group_names(members: DataFrame, classified: DataFrame) -> DataFrame:
    """id, tag: untagged members take the first tag of their cluster (member order), else the classifier's, else General.

    members: (id, cluster, tag); classified: (cluster, name).
    """
    first = members.filter("tag is not null").groupBy("cluster").agg(F.min_by("tag", F.col("id").cast("string")).alias("known"))
    named = members.join(first, "cluster", "left").join(classified, "cluster", "left")
    return named.select("id", "cluster", F.coalesce("tag", "known", "name", F.lit("General")).alias("tag"))


def _packed(rows: DataFrame, prefix: str = "") -> DataFrame:
    """(grp, size, n, ids, created, v): rows (grp, id, created, vector) of one group and vector length as pieces of up to PIECE, in one
    pass without a shuffle; rows without a vector or a group are left out."""
    kind = rows.schema["grp"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple[np.ndarray, ...]]] = {}
        counts: dict[tuple, int] = {}

        def piece(key: tuple) -> pa.RecordBatch:
            ids, created, v = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
            columns = [pa.array([key[0]], arrow), pa.array([key[1]], pa.int32()), pa.array([counts.pop(key)], pa.int32())]
            columns += [pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((ids, "<i8"), (created, "<i8"), (v, "<f8"))]
            return pa.RecordBatch.from_arrays(columns, ["grp", "size", "n", "ids", "created", "v"])

        for batch in batches:
            names = batch.column(0).dictionary_encode()
            code, ids, created, vectors = np.asarray(names.indices), np.asarray(batch.column(1), np.int64), np.asarray(batch.column(2), np.int64), batch.column(3)
            size = np.asarray(vectors.value_lengths(), np.int64)
            bounds, flat = np.asarray(vectors.offsets), np.asarray(vectors.values, float)
            for c, n in np.unique(np.stack([code, size], axis=1), axis=0).tolist():
                at, key = np.flatnonzero((code == c) & (size == n)), (names.dictionary[c].as_py(), n)
                held.setdefault(key, []).append((ids[at], created[at], flat[bounds[at][:, None] + np.arange(n)]))
                counts[key] = counts.get(key, 0) + len(at)
                if counts[key] >= PIECE:
                    yield piece(key)
            if sum(counts.values()) > HELD:
                for key in list(held):
                    yield piece(key)
        for key in list(held):
            yield piece(key)

    arrow = to_arrow_type(kind)
    whole = rows.select("grp", "id", "created", V.doubles(F.col("vector")).alias("vector")).filter("grp is not null and id is not null and created is not null and size(vector) > 0")
    made = whole.mapInArrow(run, f"grp {kind.simpleString()}, size int, n int, ids binary, created binary, v binary")
    return made.select(*[F.col(c).alias(prefix + c) for c in made.columns])


def continuity(current: DataFrame, prior: DataFrame, least: float = 0.4, k: int = 3) -> DataFrame:
    """id, prior_id, cosine, rank: earlier summarised sessions of cosine at least ``least``, the best ``k``.

    Both frames: (grp, id, created, vector); only sessions of one grp are compared. Both are packed into pieces; those of the current
    sessions are broadcast, at most BROADCAST_BYTES at a time, to where the prior ones lie, and only a piece's best ``k`` of each session are shuffled.
    """
    asked, held = _packed(current, "c_"), _packed(prior)
    sized = current.agg(F.sum(F.size("vector").cast("long") * 8).alias("bytes")).first()["bytes"] or 0
    turns = max(1, -(-sized // BROADCAST_BYTES))
    if turns > 1:
        asked, held = stored(asked, "continuity-current"), stored(held, "continuity-prior")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(i)[r].as_py() for i, c in enumerate(batch.schema.names)}
                vectors = lambda p: np.frombuffer(row[p + "v"], "<f8").reshape(row[p + "n"], row["size"])  # noqa: E731, B023
                mine, theirs, then, now = (np.frombuffer(row[c], "<i8") for c in ("c_ids", "ids", "created", "c_created"))
                s = np.round(vectors("c_") @ vectors("").T, 6)
                a, b = np.nonzero((s >= least) & (then[None, :] < now[:, None]))
                order = np.lexsort((theirs[b], -s[a, b], a))
                a, b = a[order], b[order]
                top = np.arange(len(a)) - np.searchsorted(a, np.arange(len(mine)))[a] < k
                a, b = a[top], b[top]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(mine[a]), pa.array(theirs[b]), pa.array(s[a, b])], ["id", "prior_id", "cosine"])

    found = None
    for turn in range(turns):
        block = asked if turns == 1 else asked.filter(F.pmod(F.xxhash64("c_ids"), F.lit(turns)) == turn)
        pairs = held.join(F.broadcast(block), (F.col("grp") == F.col("c_grp")) & (F.col("size") == F.col("c_size")))
        one = pairs.select("size", "n", "ids", "created", "v", "c_n", "c_ids", "c_created", "c_v").mapInArrow(best, "id long, prior_id long, cosine double")
        found = one if found is None else found.union(one)
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "prior_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
