"""Jaccard join of documents as sets of word n-grams, in the metric space of their distances.

The Jaccard distance (1 - similarity) is a metric. Links are pairs at distance r or less. Equal sets are one representative.

Documents that share nothing are all at distance 1 of each other, so no bounded number of pivots tells them apart: the
number of pivots grows with the data. Two linked sets share one of their rarest shingles (the prefix of each set under one
order); of the documents with such a shingle, the one of least hash is a pivot to all of them. A region has the
documents that see the same pivot, and every link lies in some region.

In a region of up to ``LIMIT`` documents all pairs are measured by a lower bound of their distance that the prefixes give;
pairs within r form groups. Groups, and regions of more documents, are then joined on full sets: up to ``LIMIT`` documents
exactly, all pairs at once by a product of incidence matrices. A larger one chooses pivots of its own, wider apart than ``APART``, and measures every document's distance to all of them, block by
block. A document goes to the Voronoi region of its nearest pivot q and is replicated to those of other pivots p with
d(p) <= d(q) + 2r: for x in q's region and y at distance r, d(y, q) <= d(y, its own pivot) + 2r. Documents at 1 - 2r or more of all
pivots form an open region, with those at 1 - 3r or more replicated to it. The parts are joined recursively. Documents within
r of a pivot are linked with it at once. A region that twice has hardly shrunk (a family of near copies) is joined
exactly in cells of bounded size, where only documents not yet connected are compared: its largest component against the
rest, and the rest with itself. If most of such a region isn't linked, that is quadratic in its size, as for any exact method.

Nothing is sampled, capped or dropped, and no similarity is estimated: every link is decided on full sets. Null and
empty texts, or texts without words, have no shingles and are linked with nothing. Equal rows share their component.
Rows with a null doc_id join the component of equal or similar texts, but never name one; alone, their component is null. A
doc_id names one text: where rows with different texts share one, links are decided on one of them, always the same.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import shingles as sh
from skein.llm.common import map_batches, read, stored
from skein.llm.components import connected_components
from skein.llm.near_dups import MANY_IDS, RANKED, _cells, _edges, _full_sets, _stars, by_runs

#: Regions up to LIMIT are joined at once; larger ones measure blocks of BLOCK documents against PIVOTS pivots.
LIMIT, BLOCK, PIVOTS = 64, 128, 24
#: Pivots of Voronoi regions are further than this from each other.
APART = 0.5
#: A part of more than SHRUNK times its region's size hasn't shrunk; regions are split at most DEPTH times.
SHRUNK, DEPTH = 0.8, 8
#: Lists of (region, rep) up to this length (16 bytes each) are broadcast.
MANY_ROWS = 1_000_000
_EPS = 1e-9
_PIECE = 1 << 22


def _tallies(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their place by frequency. Only the order in which shingles are tried
    follows from it, never which links are found; so shingles that don't repeat in a piece of the texts may go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            often = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(counts[often])], ["token", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.append(sh.shingle_set(text.as_py(), size))
                n += len(held[-1])
                if n > _PIECE:
                    yield counted()
                    n = 0
        if held:
            yield counted()

    found = map_batches(docs.select("text"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "token").limit(RANKED).toArrow()
    tokens = np.asarray(top.column("token"), np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], (len(tokens) - order).astype(np.int32)


def _signed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, the set's fingerprint (f1, f2) and its prefix: the rarest shingles, as many as the threshold requires."""
    known, place = _tallies(docs, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, prefixes = [], [], [], []
            for text in batch.column(1):
                held = sh.shingle_set(text.as_py(), size)
                rank = np.zeros(len(held), np.int32)
                if len(known) and len(held):
                    spot = np.minimum(np.searchsorted(known, held), len(known) - 1)
                    rank = np.where(known[spot] == held, place[spot], 0)
                a, b = sh.fingerprint(held)
                first = held[np.argsort(rank, kind="stable")[: len(held) - -(-percent * len(held) // 100) + 1]]
                n.append(len(held))
                f1.append(a)
                f2.append(b)
                prefixes.append(first.astype("<u8").tobytes() if len(held) else None)
            cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, f1, f2)), pa.array(prefixes, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "f1", "f2", "prefix"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, f1 long, f2 long, prefix binary")


def _tokens(reps: DataFrame) -> DataFrame:
    """(token, rep): the prefix shingles of representatives (rep, n_shingles, prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x.as_py(), "<i8") for x in batch.column(1)]
            if held:
                row = pa.array(np.repeat(np.arange(len(held)), [len(t) for t in held]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), batch.column(0).take(row)], ["token", "rep"])

    return map_batches(reps.select("rep", "prefix"), run, "token long, rep long")


def _sights(reps: DataFrame) -> DataFrame:
    """(region, rep): the documents that see a pivot, by its hash."""
    tokens = _tokens(reps).repartition("token")  # dealt once: the count and the join find each token's rows together
    pivots = tokens.groupBy("token").agg(F.count("*").alias("seen"), F.min(F.xxhash64("rep")).alias("region")).filter("seen > 1")
    return tokens.join(pivots.drop("seen"), "token").select("region", "rep").distinct()


def _windows(sights: DataFrame, reps: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Regions (region, rep) of up to ``LIMIT`` documents, and larger ones. Large regions are cut by the sets' sizes first: linked
    sets differ by a bounded factor, so that bands of that width, each document in its own and the next one, keep every link."""
    sizes = sights.groupBy("region").agg(F.count("*").alias("size")).filter("size > 1")
    sized = sights.join(sizes, "region")
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / (math.log(100 / percent) * 1.000001 + 1e-9))
    wide = sized.filter(F.col("size") > LIMIT).select("region", "rep").join(reps.select("rep", "n_shingles"), "rep")
    cut = wide.select(F.explode(F.array(band, band + 1)).alias("band"), "region", "rep").select(F.xxhash64("region", "band").alias("region"), "rep")
    cut = stored(cut.distinct(), "ngram-bands")
    bands = cut.join(cut.groupBy("region").agg(F.count("*").alias("size")).filter("size > 1"), "region")
    small = sized.filter(F.col("size") <= LIMIT).union(bands.filter(F.col("size") <= LIMIT)).select("region", "rep")
    return stored(small, "ngram-small"), bands.filter(F.col("size") > LIMIT).select("region", "rep")


def common_sizes(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``: a product of incidence matrices, in stretches of shingles."""
    out = np.zeros((len(a), len(b)), np.int64)
    known, times = np.unique(np.concatenate(b), return_counts=True)
    if a is b:
        known = known[times > 1]
    if not len(known):
        return out

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate(sets)
        spot = np.minimum(np.searchsorted(known, every), len(known) - 1)
        hit = known[spot] == every
        return np.repeat(np.arange(len(sets)), [len(x) for x in sets])[hit], spot[hit]

    (ra, ca), (rb, cb) = places(a), places(b)
    for lo in range(0, len(known), 1 << 14):
        hi = min(len(known), lo + (1 << 14))
        m, n = np.zeros((len(a), hi - lo), np.float32), np.zeros((len(b), hi - lo), np.float32)
        in_a, in_b = (ca >= lo) & (ca < hi), (cb >= lo) & (cb < hi)
        m[ra[in_a], ca[in_a] - lo] = 1
        n[rb[in_b], cb[in_b] - lo] = 1
        out += (m @ n.T).astype(np.int64)
    return out


def _measured(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all sets of ``a`` to all of ``b``, and which of the pairs are links (by whole numbers)."""
    common = common_sizes(a, b)
    union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - common
    return 1 - common / np.maximum(union, 1), 100 * common >= percent * union


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), "<u8") for x in column]


def _met(rows: DataFrame, held: DataFrame) -> DataFrame:
    """Rows (region, rep, ...) with what ``held`` has by rep; short lists of rows are broadcast, so that sets travel once."""
    few = rows.limit(MANY_ROWS + 1).count() <= MANY_ROWS
    return held.join(F.broadcast(rows) if few else rows, "rep")


def _loose(regions: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), as stars, of documents of one small region (region, rep) that may be links by their prefixes.

    Of two prefixes one ends first in the common order; what that set shares with the other is in both prefixes or behind its
    own. So the intersection is at most the common part of the prefixes and the longer remainder: a lower bound of the distance.
    Prefixes travel as 32 bits of each shingle; what that merges is added to the bound.
    """

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.unique((np.frombuffer(x.as_py(), "<u8") >> np.uint64(32)).astype("<u4")).tobytes() for x in batch.column(2)]
            behind = [n.as_py() - len(x.as_py()) // 8 for n, x in zip(batch.column(1), batch.column(2), strict=True)]
            merged = [len(x.as_py()) // 8 - len(h) // 4 for h, x in zip(held, batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(behind, pa.int64()), pa.array(merged, pa.int64()), pa.array(held, pa.binary())], ["rep", "n", "behind", "merged", "short"]
            )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if batch.num_rows < 2:
            return None
        rep, n, behind, merged = (np.array(batch.column(k), np.int64) for k in (1, 2, 3, 4))
        short = [np.frombuffer(x.as_py(), "<u4") for x in batch.column(5)]
        most = common_sizes(short, short) + np.minimum.outer(merged, merged) + np.maximum.outer(behind, behind)
        near = most * (100 + percent) >= percent * (n[:, None] + n[None, :])
        near &= 100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n)
        return _edges(_stars(rep, *np.nonzero(np.triu(near, 1)), lambda i, j: True))

    short = map_batches(reps.select("rep", "n_shingles", "prefix"), shortened, "rep long, n long, behind long, merged long, short binary")
    return by_runs(_met(regions, short).select("region", "rep", "n", "behind", "merged", "short"), "region", "a long, b long", work).distinct()


def _joined(rows: DataFrame, percent: int) -> DataFrame:
    """Links, as stars, inside regions (region, rep, set) of bounded size."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if batch.num_rows < 2:
            return None
        sets = _sets(batch.column(2))
        linked = np.triu(_measured(sets, sets, percent)[1], 1)
        return _edges(_stars(np.array(batch.column(1), np.int64), *np.nonzero(linked), lambda i, j: True))

    return by_runs(rows, "region", "a long, b long", work).distinct()


def _split(members: DataFrame, sets: DataFrame, depth: int, percent: int) -> DataFrame:
    """Large regions (region, rep, size) measured against pivots of their own.

    Rows (p, q, parent): links p, q with null parent; or the part p of a region of ``parent`` documents, and a document q of it.
    """
    r = 1 - percent / 100
    far = 1 - 2 * r
    order = F.xxhash64("rep") if depth == 0 else F.xxhash64("rep", F.lit(depth))
    first = Window.partitionBy("region").orderBy("order", "rep")
    pivots = members.withColumn("order", order).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= PIVOTS)
    pivots = stored(pivots.select("region", "rep", "place", "size").join(sets, "rep"), "ngram-pivots")
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    block = F.xxhash64("region", "lot").alias("block")
    rows = members.withColumn("lot", F.pmod(F.xxhash64("rep", F.lit("lot")), blocks))
    rows = _met(rows, sets)
    rows = rows.select(block, "region", "rep", "size", F.lit(0).alias("place"), "set")
    spread = pivots.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).select(block, "region", "rep", "size", "place", "set")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        region, rep, place = (np.array(batch.column(k), np.int64) for k in (1, 2, 4))
        sets = _sets(batch.column(5))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for one in np.unique(region):
            own = np.flatnonzero((region == one) & (place == 0))
            centre = np.flatnonzero((region == one) & (place > 0))
            centre = centre[np.argsort(place[centre])]
            if not len(own) or not len(centre):
                continue
            size = np.array(batch.column(3).slice(int(own[0]), 1), np.int64)[0]
            near, linked = _measured([sets[k] for k in own], [sets[k] for k in centre], percent)
            # Documents are linked with the first pivot within r, and pivots with each other.
            hit = linked.any(axis=1)
            p, q = rep[centre][linked.argmax(axis=1)][hit], rep[own][hit]
            mutual, tied = _measured([sets[k] for k in centre], [sets[k] for k in centre], percent)
            i, j = np.nonzero(np.triu(tied, 1))
            p, q = np.concatenate([p, rep[centre][i]]), np.concatenate([q, rep[centre][j]])
            out.append((p, q, np.full(len(p), -1)))
            chosen: list[int] = []
            for k in range(len(centre)):
                if all(mutual[k, c] > APART for c in chosen):
                    chosen.append(k)
            near = near[:, chosen]
            least = near.min(axis=1)
            base = sh.mix(np.array([one], np.int64).view(np.uint64) + np.uint64(depth + 1))
            for c, k in enumerate(chosen):
                inside = (least < far) & (near[:, c] <= least + 2 * r + _EPS)
                name = sh.mix(base ^ sh.mix(rep[centre[k : k + 1]].view(np.uint64))).view(np.int64)
                out.append((np.repeat(name, int(inside.sum())), rep[own][inside], np.full(int(inside.sum()), size)))
            opened = least >= far - r - _EPS
            out.append((np.repeat(sh.mix(base).view(np.int64), int(opened.sum())), rep[own][opened], np.full(int(opened.sum()), size)))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], ["p", "q", "parent"])

    return stored(by_runs(rows.union(spread), "block", "p long, q long, parent long", work), "ngram-parts")


def _crossing(hard: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between documents of regions (region, rep) that ``links`` haven't connected yet, in cells of bounded size."""
    known = connected_components(links).select(F.col("id").alias("rep"), "component")
    rows = hard.join(known, "rep", "left").select("region", "rep", F.coalesce("component", "rep").alias("comp"))
    rows = stored(rows, "ngram-hard")
    several = rows.groupBy("region").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("region", "n")
    live = rows.join(several, "region").select(F.col("region").alias("token"), "rep", "comp", F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit(None).cast("binary").alias("sketch"), "n")
    cells = _cells(live).select("cell", "rep", "comp", "side").join(sets, "rep").select("cell", "rep", "comp", "side", "set")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rep, comp, side = (np.array(batch.column(k), np.int64) for k in (1, 2, 3))
        ok = (comp[:, None] != comp[None, :]) & ((side[:, None] != side[None, :]) | (side[:, None] == 2))
        if not ok.any():
            return None
        sets = _sets(batch.column(4))
        linked = np.triu(_measured(sets, sets, percent)[1] & ok, 1)
        return _edges(_stars(rep, *np.nonzero(linked), lambda i, j: True))

    return by_runs(cells, "cell", "a long, b long", work)


def _links(regions: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), as stars, in all regions (region, rep)."""
    found: list[DataFrame] = []
    stars: list[DataFrame] = []
    hard: list[DataFrame] = []
    left = regions.withColumn("parent", F.lit(None).cast("long"))
    for depth in range(DEPTH + 1):
        sizes = left.groupBy("region").agg(F.count("*").alias("size"), F.max("parent").alias("parent")).filter("size > 1")
        sized = stored(left.drop("parent").join(sizes, "region"), "ngram-regions")
        found.append(_joined(_met(sized.filter(F.col("size") <= LIMIT).select("region", "rep"), sets).select("region", "rep", "set"), percent))
        large = sized.filter(F.col("size") > LIMIT)
        stuck = (F.col("size") > SHRUNK * F.col("parent")) if 1 < depth < DEPTH else F.lit(depth == DEPTH)
        hard.append(large.filter(stuck).select("region", "rep"))
        large = large.filter(F.coalesce(~stuck, F.lit(True)))
        if large.limit(1).count() == 0:
            break
        parts = _split(large.select("region", "rep", "size"), sets, depth, percent)
        stars.append(parts.filter("parent < 0").select(F.col("p").alias("a"), F.col("q").alias("b")).filter("a <> b").distinct())
        left = parts.filter("parent >= 0").select(F.col("p").alias("region"), F.col("q").alias("rep"), "parent")
    if stars:
        near = stored(reduce(DataFrame.union, stars), "ngram-stars")
        found += [near, _crossing(reduce(DataFrame.union, hard), near, sets, percent)]
    return reduce(DataFrame.union, found)


def ngram_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: links are 100 * common >= percent * union of sets of ``size``-word shingles."""
    if not 67 <= percent <= 100:
        raise ValueError("percent must be 67 to 100: windows of regions are three radii wide")
    signed = stored(_signed(docs, size, percent), "ngram-signed")
    reps = stored(signed.filter("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep")).filter("rep is not null"), "ngram-reps")
    ids = reps.select("rep").distinct()
    few = ids.limit(MANY_IDS + 1).count() <= MANY_IDS
    firsts = signed.filter("n_shingles > 0").join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("rep"), "left_semi")
    firsts = firsts.select(F.col("doc_id").alias("rep"), "n_shingles", "prefix")
    repeated = firsts.count() > ids.count()
    if repeated:
        firsts = firsts.dropDuplicates()

    small, large = _windows(stored(_sights(firsts), "ngram-sights"), firsts, percent)
    groups = connected_components(_loose(small, firsts, percent))
    groups = groups.select(F.xxhash64("component", F.lit("group")).alias("region"), F.col("id").alias("rep"))
    regions = stored(groups.union(large), "ngram-groups")
    wanted = stored(regions.select("rep").distinct(), "ngram-wanted")
    sets = _full_sets(docs, wanted, size)
    sets = stored(sets.groupBy("rep").agg(F.max("set").alias("set")) if repeated else sets, "ngram-sets")
    components = connected_components(stored(_links(regions, sets, percent), "ngram-links"))

    named = reps.select("f1", "f2", "n_shingles", "rep").join(components.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("f1", "f2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = signed.drop("prefix").join(named, ["f1", "f2", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op11_ngram_join(spark, sf_dir):
    return ngram_components(read(spark, sf_dir, "documents"))
