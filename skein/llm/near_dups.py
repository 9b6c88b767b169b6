"""Near-duplicate documents by a chosen-path set similarity join over MinHash.

Documents are sets of distinct 5-word shingles of their whole texts. Equal sets are one representative. Every
representative walks several independent trees: a node chooses, by its own hash, one signature position or two (so
that a pair at the threshold keeps one common child on average at every level), and the document goes on to the
children named by its minwise tokens there: similar documents stay together and others part. Documents that share a
node of at most ``LIMIT`` members are compared exhaustively; larger nodes branch on to the next stop. The estimates
of small nodes form loose groups, and links are confirmed pair by pair on full shingle sets.

Nodes that are large at any stop (families of copies, shared templates) and large loose groups are finished exactly:
their members are first linked with a few central members of their node, on full sets; then members of different
components that share a shingle in the prefixes of their sets (rare shingles first, as long as the threshold
requires) are compared, so that no link between components is lost whatever a group's size. Popular prefix shingles
are compared in cells of bounded size. Components are the connected components of all confirmed links.

Null or empty texts, or texts without words, have no shingles and are linked with nothing. Equal rows share their
component. Rows with a null doc_id join the component of equal or similar texts but never name one; alone, their
component is null and they are kept. A doc_id names one text: where rows with different texts share one, links of either
text's nodes are confirmed on one of them, always the same. Other columns are ignored or passed through. Nothing is dropped, sampled or capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import shingles as sh
from skein.llm.common import map_batches, read, stored
from skein.llm.components import connected_components

#: Signature positions, trees, and levels at which nodes are compared.
POSITIONS, TREES, STOPS = 128, 16, (3, 7)
#: Nodes up to LIMIT are compared exhaustively; PIVOTS central members of larger ones are elected in heats of HEAT.
LIMIT, HEAT, PIVOTS = 64, 48, 16
#: Loose groups up to this size are confirmed pair by pair in one piece.
SMALL = 128
#: Estimates this far below the threshold still make candidates (about five standard errors).
MARGIN = 0.16
#: Members of a cell in which prefix shingles are compared.
CELL = 256
#: Repeated shingles whose order of frequency is known to the tasks (12 bytes each). Any order gives the same links.
RANKED = 1 << 19
#: Id lists up to this length (8 bytes each) are broadcast.
MANY_IDS = 1_000_000


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the set's fingerprint (f1, f2), its signature (sig: 128 little-endian uint32) and that one's lowest bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = sh.MinHash(POSITIONS)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, f1, f2, sigs, low = [], [], [], [], []
                for text in part.column(1):
                    s = sh.shingle_set(text.as_py())
                    a, b = sh.fingerprint(s)
                    n.append(len(s))
                    f1.append(a)
                    f2.append(b)
                    sig = minhash.signature(s) if len(s) else None
                    sigs.append(sig if sig is None else sig.tobytes())
                    low.append(sig if sig is None else sig.astype(np.uint8).tobytes())
                cols = [part.column(0), *(pa.array(x, pa.int64()) for x in (n, f1, f2)), *(pa.array(x, pa.binary()) for x in (sigs, low))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "f1", "f2", "sig", "sketch"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, f1 long, f2 long, sig binary, sketch binary")


def _children(sig: np.ndarray, row: np.ndarray, node: np.ndarray, levels: int, second: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and nodes ``levels`` further down; a node chooses another position with the chance ``second``."""
    for _ in range(levels):
        h = sh.mix(node + np.uint64(1))
        first = (h % np.uint64(POSITIONS)).astype(np.int64)
        draw = (sh.mix(h) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        other = (first + 1 + ((h >> np.uint64(32)) % np.uint64(POSITIONS - 1)).astype(np.int64)) % POSITIONS
        more = draw < second
        row2 = np.concatenate([row, row[more]])
        node2 = np.concatenate([node, node[more]])
        at = np.concatenate([first, other[more]])
        token = sig[row2, at].astype(np.uint64)
        node = sh.mix(sh.mix(node2 ^ (at.astype(np.uint64) << np.uint64(40))) + token * np.uint64(0x9E3779B97F4A7C15))
        row = row2
    return row, node


def _walk(rows: DataFrame, level: int, stop: int, second: float) -> DataFrame:
    """(node, rep) at level ``stop``: from the roots of all trees, or from each row's ``node`` at ``level``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                n = part.num_rows
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u4").reshape(n, POSITIONS)
                reps = np.array(part.column(0), np.int64)
                if level:
                    row, node = np.arange(n), np.array(part.column(2), np.int64).view(np.uint64)
                else:
                    row = np.repeat(np.arange(n), TREES)
                    node = np.tile(sh.mix(np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)), n)
                row, node = _children(sig, row, node, stop - level, second)
                pairs = np.unique(np.stack([node.view(np.int64), reps[row]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["node", "rep"])

    columns = ["rep", "sig"] + (["node"] if level else [])
    return map_batches(rows.select(*columns), run, "node long, rep long")


def _shared(keys: DataFrame) -> DataFrame:
    """Rows of nodes with two members or more, with the node's size; sizes are pre-aggregated before the shuffle."""
    sizes = keys.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
    return keys.join(sizes, "node")


def by_runs(rows: DataFrame, key: str, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """Apply ``work`` to each run of equal ``key`` in rows dealt and sorted by it; runs are of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        last = None
        out: list[pa.RecordBatch] = []

        def finish():
            if kept:
                whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                done = work(whole)
                if done is not None and done.num_rows:
                    out.append(done)
            kept.clear()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = np.array(batch.column(0))
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if kept and last != keys[lo]:
                    finish()
                kept.append(batch.slice(lo, hi - lo))
                last = keys[lo]
            if len(out) > 256:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out.clear()
        finish()
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    others = [c for c in rows.columns if c != key]
    dealt = rows.select(key, *others).repartition(F.col(key)).sortWithinPartitions(key)
    return map_batches(dealt, run, schema)


def _sketches(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(at).to_pylist()), np.uint8).reshape(batch.num_rows, -1)


def _estimates(sketch: np.ndarray) -> np.ndarray:
    """Estimated similarities of all pairs from the lowest bytes of signatures, corrected for chance."""
    n = len(sketch)
    same = np.empty((n, n), np.float32)
    for i in range(n):
        same[i] = (sketch == sketch[i]).mean(axis=1)
    return (same - 1 / 256) / (1 - 1 / 256)


def _stars(ids: np.ndarray, a: np.ndarray, b: np.ndarray, linked: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Links pairs in the given order where ``linked`` says so; each group as a star around its smallest id."""
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y and linked(i, j):
            if ids[x] > ids[y]:
                x, y = y, x
            parent[y] = x
    return [(int(ids[find(k)]), int(ids[k])) for k in range(len(ids)) if find(k) != k]


def _edges(stars: list[tuple[int, int]]) -> pa.RecordBatch | None:
    if not stars:
        return None
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*stars, strict=True)], ["a", "b"])


def _elect(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The four most central members of a heat: (node, rep, score)."""
    score = _estimates(_sketches(batch, 3)).mean(axis=1)
    best = np.argsort(-score, kind="stable")[:4]
    return pa.RecordBatch.from_arrays(
        [batch.column(1).take(pa.array(best)), batch.column(2).take(pa.array(best)), pa.array(score[best].astype(np.float64))], ["node", "rep", "score"]
    )


def _pivot_links(members: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): members b of large groups (node, rep) that confirmed links join with a central member a of their group.

    Every block of a group holds all its pivots, so that each finds the same components of pivots, and a is theirs.
    """
    sizes = members.groupBy("node").agg(F.ceil(F.count("*") / F.lit(HEAT)).cast("long").alias("heats"))
    heats = members.join(sizes, "node").withColumn("heat", F.pmod(F.xxhash64("node", "rep"), F.col("heats")))
    heats = stored(heats.withColumn("block", F.xxhash64("node", "heat", F.lit("block"))), "dup-heats")
    ranked = by_runs(heats.join(sketches, "rep").select("block", "node", "rep", "sketch"), "block", "node long, rep long, score double", _elect)
    best = Window.partitionBy("node").orderBy(F.desc("score"), "rep")
    pivots = ranked.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= PIVOTS).select("node", "rep")
    pivots = stored(pivots.join(sizes, "node").join(sets, "rep"), "dup-pivots")
    spread = pivots.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("heats") - 1)).alias("heat"), "node", "rep", "set")
    spread = spread.select(F.xxhash64("node", "heat", F.lit("block")).alias("block"), "rep", "set", F.lit(True).alias("pivot"))
    rows = heats.select("block", "rep").join(sets, "rep").select("block", "rep", "set", F.lit(False).alias("pivot")).union(spread)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = np.array(batch.column(1), np.int64)
        held = [np.frombuffer(x.as_py(), "<u8") for x in batch.column(2)]
        pivot = np.array(batch.column(3).to_pylist(), bool)
        centre = np.flatnonzero(pivot)
        centre = centre[np.argsort(ids[centre])]
        a, b = np.triu_indices(len(centre), 1)
        root = {int(p): int(ids[p]) for p in centre}
        near = _stars(ids[centre], a, b, lambda i, j: _linked(held[centre[i]], held[centre[j]], percent))
        known = dict((y, x) for x, y in near)
        root = {p: known.get(r, r) for p, r in root.items()}
        out = list(near)
        for i in np.flatnonzero(~pivot):
            # One link is enough; the next pivots stand in where the first does not link.
            p = next((p for p in centre if _linked(held[i], held[p], percent)), None)
            if p is not None and root[int(p)] != ids[i]:
                out.append((root[int(p)], int(ids[i])))
        return _edges(out)

    return by_runs(rows, "block", "a long, b long", work).distinct()


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if min(len(a), len(b)) * 100 < max(len(a), len(b)) * percent:
        return False
    common = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _loose_links(block_rows: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Candidate links inside blocks, as stars: a group is what estimates of at least ``least`` connect."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = np.array(batch.column(1), np.int64)
        if len(ids) < 2:
            return None
        est = _estimates(_sketches(batch, 2))
        a, b = np.nonzero(np.triu(est >= least, 1))
        return _edges(_stars(ids, a, b, lambda i, j: True))

    return by_runs(block_rows.join(sketches, "rep").select("block", "rep", "sketch"), "block", "a long, b long", work).distinct()


def _confirmed(rows: DataFrame, percent: int) -> DataFrame:
    """Confirmed links, as stars, in groups (key, rep, set) of bounded size: all pairs decided on full sets."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = np.array(batch.column(1), np.int64)
        if len(ids) < 2:
            return None
        sets = [np.frombuffer(x.as_py(), "<u8") for x in batch.column(2)]
        a, b = np.triu_indices(len(ids), 1)
        return _edges(_stars(ids, a, b, lambda i, j: _linked(sets[i], sets[j], percent)))

    return by_runs(rows, rows.columns[0], "a long, b long", work)


def _repeated_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles that repeat within some piece of the sets, sorted, and their place by frequency.

    Only the order in which shingles are tried follows from it, never which links are found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            again = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(tokens[again].view(np.int64)), pa.array(counts[again])], ["token", "n"])

        for batch in batches:
            for x in batch.column(0):
                held.append(np.frombuffer(x.as_py(), "<u8"))
                n += len(held[-1])
                if n > 1 << 21:
                    yield counted()
                    n = 0
        if held:
            yield counted()

    found = map_batches(sets.select("set"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "token").limit(RANKED).toArrow()
    tokens = np.asarray(top.column("token"), np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], (len(tokens) - order).astype(np.int32)


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(token, rep, comp, at, size): the shingles of each set's prefix, rare ones first; sets are (rep, comp, set)."""
    known, place = _repeated_shingles(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                tokens, at, size = [], [], []
                for x in part.column(2):
                    held = np.frombuffer(x.as_py(), "<u8")
                    n = len(held)
                    rank = np.zeros(n, np.int32)
                    if len(known):
                        spot = np.minimum(np.searchsorted(known, held), len(known) - 1)
                        rank = np.where(known[spot] == held, place[spot], 0)
                    first = held[np.argsort(rank, kind="stable")[: n - -(-percent * n // 100) + 1]]
                    tokens.append(first.view(np.int64))
                    at.append(np.arange(len(first), dtype=np.int32))
                    size.append(n)
                times = np.array([len(t) for t in tokens])
                row = pa.array(np.repeat(np.arange(len(tokens)), times))
                columns = [
                    pa.array(np.concatenate(tokens)), part.column(0).take(row), part.column(1).take(row), pa.array(np.concatenate(at)),
                    pa.array(np.repeat(np.array(size, np.int32), times)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["token", "rep", "comp", "at", "size"])

    return map_batches(sets.select("rep", "comp", "set"), run, "token long, rep long, comp long, at int, size int")


def _cells(live: DataFrame) -> DataFrame:
    """(cell, rep, comp, at, size, sketch, side): rows that share a token, in cells of bounded size.

    Up to CELL rows of a token are one cell. Of a more popular token, the rows of its most frequent component are
    apart from the rest: the rest is compared with them and with itself, chunk by chunk. Rows of one side of a cell
    aren't compared, but those of side 2 are.
    """
    columns = ["rep", "comp", "at", "size", "sketch"]
    cold = live.filter(F.col("n") <= CELL).select(F.col("token").alias("cell"), *columns, F.lit(2).alias("side"))
    hot = live.filter(F.col("n") > CELL)
    if hot.limit(1).count() == 0:
        return cold
    per = hot.groupBy("token", "comp").agg(F.count("*").alias("c"))
    per = per.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("mass"), F.max("c").alias("most"), F.sum("c").alias("all"))
    half = CELL // 2
    per = per.filter("all > most").select(
        "token", "mass", F.ceil(F.col("most") / half).alias("lots"), F.ceil((F.col("all") - F.col("most")) / half).alias("rests")
    )
    hot = hot.join(per, "token")
    deal = F.xxhash64("rep", F.lit("cell"))

    def cell(*parts):
        return F.xxhash64("token", *parts).alias("cell")

    mass = hot.filter("comp = mass").withColumn("lot", F.pmod(deal, F.col("lots"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1)))
    mass = mass.select(cell(F.lit("lot"), "lot", "other"), *columns, F.lit(1).alias("side"))
    rest = hot.filter("comp <> mass").withColumn("own", F.pmod(deal, F.col("rests")))
    against = rest.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)))
    against = against.select(cell(F.lit("lot"), "lot", "own"), *columns, F.lit(0).alias("side"))
    among = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1)))
    side = F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(2)
    among = among.select(cell(F.lit("rest"), F.least("own", "other"), F.greatest("own", "other")), *columns, side.alias("side"))
    return cold.union(mass).union(against).union(among)


def _live(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (token, rep, comp, at, size, ...) whose token leaves room for a link with another component, with its rows' number n."""
    tokens = rows.groupBy("token").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("size").alias("least"))
    tokens = stored(tokens.filter("lo < hi").select("token", "n", "least"), "dup-tokens")
    live = rows.join(tokens, "token")
    partner = F.greatest(F.col("least").cast("double"), F.col("size") * percent / 100.0)
    room = (F.col("size") - F.col("at")) * (100 + percent) >= percent * (F.col("size") + partner) - 0.001
    return live.filter(room).drop("least")


def _crossing_pairs(live: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs (a, b, of components ca, cb) whose shared prefix shingles leave room for enough common ones and whose
    estimates make them candidates; with ``best`` only each row's most similar partner in a cell."""
    least = percent / 100 - MARGIN

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rep, comp, at, size = (np.array(batch.column(k), np.int64) for k in (1, 2, 3, 4))
        side = np.array(batch.column(6))
        need = percent * (size[:, None] + size[None, :])
        ok = np.minimum.outer(size - at, size - at) * (100 + percent) >= need
        ok &= (comp[:, None] != comp[None, :]) & ((side[:, None] != side[None, :]) | (side[:, None] == 2))
        if not ok.any():
            return None
        est = np.where(ok, _estimates(_sketches(batch, 5)), 0)
        if best:
            a, b = np.arange(len(rep)), est.argmax(axis=1)
            keep = est[a, b] >= least
            a, b = a[keep], b[keep]
        else:
            a, b = np.nonzero(np.triu(est >= least, 1))
        swap = rep[a] > rep[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (rep[a], rep[b], comp[a], comp[b])], ["a", "b", "ca", "cb"])

    return by_runs(_cells(live), "cell", "a long, b long, ca long, cb long", work).distinct()


def _prefix_links(members: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) that join components of ``members`` (rep, comp).

    First each row's best partners are tried, which joins most components that belong together; then all pairs that
    still cross components.
    """
    rows = stored(_prefixes(members.join(sets, "rep").select("rep", "comp", "set"), percent), "dup-prefixes")
    live = stored(_live(rows, percent).join(sketches, "rep"), "dup-live")
    first = stored(_confirmed_pairs(_crossing_pairs(live, percent, True), sets, percent), "dup-confirmed")
    merged = connected_components(first.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    merged = merged.filter("id <> component").withColumnRenamed("id", "comp")
    rows = live.drop("n").join(merged, "comp", "left")
    rows = rows.withColumn("comp", F.coalesce("component", "comp")).drop("component")
    pairs = _crossing_pairs(stored(_live(rows, percent), "dup-live"), percent, False)
    return first.union(_confirmed_pairs(pairs, sets, percent)).select("a", "b")


def _confirmed_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ca, cb) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("s")), "a").join(sets.select(F.col("rep").alias("b"), F.col("set").alias("t")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [
                _linked(np.frombuffer(s.as_py(), "<u8"), np.frombuffer(t.as_py(), "<u8"), percent)
                for s, t in zip(batch.column(4), batch.column(5), strict=True)
            ]
            yield batch.select(["a", "b", "ca", "cb"]).filter(pa.array(ok, pa.bool_()))

    return map_batches(both.select("a", "b", "ca", "cb", "s", "t"), run, "a long, b long, ca long, cb long")


def _full_sets(docs: DataFrame, ids: DataFrame, size: int = sh.SIZE) -> DataFrame:
    """rep and its sorted shingle hashes (set: little-endian uint64), for the wanted representatives only."""
    few = ids.limit(MANY_IDS + 1).count() <= MANY_IDS
    wanted = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("rep"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                sets = [sh.shingle_set(t.as_py(), size).astype("<u8").tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["rep", "set"])

    return map_batches(wanted, run, "rep long, set binary")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``; links are 100 * common >= percent * union."""
    signed = stored(signatures(docs), "dup-signatures")
    reps = signed.filter("n_shingles > 0").groupBy("f1", "f2", "n_shingles")
    reps = reps.agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    reps = stored(reps.filter("rep is not null"), "dup-reps")
    sketches = reps.select("rep", "sketch")

    blocks, hot, ever = [], None, []
    for level, stop in zip((0, *STOPS), STOPS, strict=False):
        rows = reps if hot is None else hot.select("node", "rep").join(reps.select("rep", "sig"), "rep")
        keys = _walk(rows, level, stop, 100 / percent - 1)
        shared = stored(_shared(stored(keys if hot is None else keys.distinct(), "dup-keys")), "dup-shared")
        blocks.append(shared.filter(F.col("size") <= LIMIT).select(F.col("node").alias("block"), "rep"))
        hot = shared.filter(F.col("size") > LIMIT)
        if hot.limit(1).count() == 0:
            break
        ever.append(hot.select("rep", "size", "node"))

    loose = connected_components(_loose_links(reduce(DataFrame.union, blocks), sketches, percent / 100 - MARGIN))
    sizes = loose.groupBy("component").agg(F.count("*").alias("members"))
    loose = stored(loose.join(sizes, "component"), "dup-loose")
    # Each member of a large group belongs to one of them: the largest node that was hot at any stop, or else its loose group.
    large = loose.filter(F.col("members") > SMALL).select(F.col("id").alias("rep"), F.lit(0).cast("long").alias("size"), F.col("component").alias("node"))
    large = reduce(DataFrame.union, ever, large).groupBy("rep").agg(F.max(F.struct("size", "node")).alias("x"))
    large = stored(large.select(F.col("x.node").alias("node"), "rep"), "dup-large")
    wanted = loose.select(F.col("id").alias("rep")).union(large.select("rep")).distinct()
    sets = stored(_full_sets(docs, stored(wanted, "dup-wanted")).groupBy("rep").agg(F.max("set").alias("set")), "dup-sets")

    small = loose.filter(F.col("members") <= SMALL).select(F.col("component").alias("key"), F.col("id").alias("rep"))
    links = _confirmed(small.join(sets, "rep").select("key", "rep", "set"), percent)
    if large.limit(1).count():
        near = stored(_pivot_links(large, sketches, sets, percent), "dup-near")
        own = near.groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("a"))
        held = large.select("rep").join(own, "rep", "left").select("rep", F.coalesce("a", "rep").alias("comp"))
        links = links.union(near).union(_prefix_links(held, sketches, sets, percent))
    components = connected_components(stored(links, "dup-links"))

    named = reps.select("f1", "f2", "n_shingles", "rep").join(components.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("f1", "f2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = signed.drop("sig", "sketch").join(named, ["f1", "f2", "n_shingles"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")), F.lit(False)))


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of each component stays, columns unchanged: that of the smallest doc_id (of equal ids, all)."""
    gone = near_duplicates(docs, percent).filter("not kept").select("doc_id").distinct()
    gone = stored(gone, "dup-gone")
    few = gone.limit(MANY_IDS + 1).count() <= MANY_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")


def op8_near_duplicates(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))
