"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents are dealt into blocks of about ``block_docs`` rows inside their source. Each source gets an exact
quota of blocks: whole passes while its target exceeds its size, then the permuted prefix of blocks that fills the
rest, the last of them document by document; words that it can't fill are carried to documents of the other blocks.
The quotas are split among the output shards by recursive halving: a node's quotas go left by sampling without
replacement (a multivariate-hypergeometric draw), the remainder right, so every shard gets its share and no block
instance lands twice. A node draws one number a source, by inversion from the mode outwards, so that its work grows with
the root of its blocks only, and all nodes draw alike whatever the table's size. A shard's rows are then shuffled inside it.

Only DataFrame functions are used. What is held in one row is the vector of quotas, one number for each source, and
what one task orders is the list of sources; nothing that grows with the documents is gathered.

Null or empty texts have size 0 and are never taken. Null sources form one source, last in order. Equal rows are taken
together or not at all. Extra columns pass through untouched, whatever their names, where rows are returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import free_name, read, stored, word_count

#: Source weights, repeating along the sources in code point order.
WEIGHTS = (1.0, 2.0, 3.0)
#: No document is taken more often than this.
MAX_PASSES = 3
#: Source tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 4096
#: Counts that a draw of the splitting tree looks at in one sequence; longer walks take several, with the same result.
DRAWN = 1 << 16
#: Depth of the tree at which its nodes are dealt to tasks.
SPREAD = 6


def _uniform(*parts: Column) -> Column:
    """A keyed uniform number in [0, 1)."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def source_targets(sized: DataFrame, weights=WEIGHTS, cap: float = MAX_PASSES) -> DataFrame:
    """Per source: rank, docs, source_size, target. Targets share the total by weight and stop at ``cap`` sizes.

    Resharing the excess until no target is above its cap ends at min(cap * size, level * weight) with one common
    level, found here in a single pass over the sources ordered by the level at which each is capped.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    per = per.withColumn("bar", F.col("most") / F.col("weight"))
    capped = Window.orderBy("bar", "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.withColumn("before_most", F.coalesce(F.sum("most").over(capped), F.lit(0.0)))
    per = per.withColumn("before_weight", F.coalesce(F.sum("weight").over(capped), F.lit(0.0)))
    level = (F.sum("source_size").over(everything) - F.col("before_most")) / (F.sum("weight").over(everything) - F.col("before_weight"))
    per = per.withColumn("here", level)
    per = per.withColumn("level", F.max(F.when(F.col("here") <= F.col("bar"), F.col("here"))).over(everything))
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return per.select("source", "rank", "docs", "source_size", target.alias("target"))


def row_key() -> Column:
    """Identifies a document row by its content."""
    return F.xxhash64("doc_id", "source", F.xxhash64("text"))


def _block_quotas(sized: DataFrame, targets: DataFrame, block_docs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Blocks with how they are taken in the partial pass, and the documents labelled with their block."""
    label = targets.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("docs") / F.lit(block_docs))).cast("long"))
    small = targets.count() <= BROADCAST_SOURCES
    docs = sized.alias("d").join(F.broadcast(label) if small else label, sized["source"].eqNullSafe(label["source"]), "inner")
    key = F.xxhash64(F.lit(seed), F.lit("doc"), F.col("row_key"))
    docs = docs.select(
        sized["row_key"], "doc_id", sized["source"], "size", "rank", "source_size", "target", key.alias("doc_order"),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), F.col("row_key")), F.col("blocks")).alias("block"),
    )
    blocks = docs.groupBy("rank", "block").agg(
        F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target")
    )
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    blocks = blocks.withColumn("passes", passes.cast("int"))
    blocks = blocks.withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    blocks = blocks.withColumn("perm", F.xxhash64(F.lit(seed), F.lit("perm"), "rank", "block"))
    # Running words along the permuted blocks in two steps, so that no source is one task: a run of blocks, then inside.
    blocks = blocks.withColumn("run", F.shiftrightunsigned("perm", 54))
    runs = blocks.groupBy("rank", "run").agg(F.sum("words").alias("run_words"), F.count("*").alias("run_blocks"))
    ahead = Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "rank", "run", F.coalesce(F.sum("run_words").over(ahead), F.lit(0)).alias("run_start"),
        F.coalesce(F.sum("run_blocks").over(ahead), F.lit(0)).alias("run_first"),
    )
    inside = Window.partitionBy("rank", "run").orderBy("perm", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("in_start", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    blocks = blocks.withColumn("in_first", F.count(F.lit(1)).over(inside))
    blocks = blocks.join(runs, ["rank", "run"])
    start = F.col("run_start") + F.col("in_start")
    blocks = blocks.select(
        "rank", "block", "words", "passes", "perm",
        (F.col("run_first") + F.col("in_first")).cast("long").alias("place"),
        F.when(F.col("rest") <= start, F.lit(0)).when(start + F.col("words") <= F.col("rest"), F.lit(2)).otherwise(F.lit(1)).alias("part"),
        (F.col("rest") - start).alias("left"),
    )
    return blocks, docs


def _split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, rank, quota) from one row of per-source quotas ``q`` array<struct<rank,n>>, by recursive halving.

    A node's sources are visited in order: of a source's ``k`` items, ``n`` places left on the left and ``r`` items still to
    come, a hypergeometric number goes left. So the counts are multivariate hypergeometric and fill both halves exactly.
    Weights are relative to the mode's; beyond 12 standard deviations and 30 counts they are less than a uniform number's step.
    """

    def walk(start: str, step: str) -> str:
        return f"""aggregate(if(v.h > 0, sequence(0L, (v.h - 1) div {DRAWN}), cast(array() as array<bigint>)), {start}, (a, c) ->
            aggregate(sequence(c * {DRAWN} + 1, least(v.h, (c + 1) * {DRAWN})), a, (b, i) -> {step}))"""

    up = "b.up * ((v.k - v.m - i + 1D) * (v.n - v.m - i + 1D) / ((v.m + i * 1D) * (v.r - v.k - v.n + v.m + i * 1D)))"
    down = "b.down * ((v.m - i + 1D) * (v.r - v.k - v.n + v.m - i + 1D) / ((v.k - v.m + i * 1D) * (v.n - v.m + i * 1D)))"
    total = walk("named_struct('up', 1D, 'down', 1D, 'sum', 1D)", f"named_struct('up', {up}, 'down', {down}, 'sum', b.sum + {up} + {down})")
    found = walk(
        "named_struct('up', 1D, 'down', 1D, 'sum', 1D, 'at', if(1D > v.goal, v.m, cast(null as bigint)))",
        f"named_struct('up', {up}, 'down', {down}, 'sum', b.sum + {up} + {down}, 'at', coalesce(b.at, if(b.sum + {up} > v.goal, v.m + i, if(b.sum + {up} + {down} > v.goal, v.m - i, cast(null as bigint)))))",
    )
    node = """named_struct('n', s.room, 'k', x.n, 'r', s.rest,
        'm', greatest(0L, s.room - s.rest + x.n, least(x.n, s.room, cast(floor((s.room + 1D) * (x.n + 1D) / (s.rest + 2D)) as bigint))),
        'h', least(x.n, s.room, 30 + cast(ceil(12D * sqrt(s.room * (x.n * 1D / greatest(1L, s.rest)) * (1D - x.n * 1D / greatest(1L, s.rest)) * (s.rest - s.room) / greatest(1L, s.rest - 1))) as bigint)))"""
    sure = f"pmod(xxhash64({seed}, lo, hi, x.rank), 9007199254740992L) / 9007199254740992D"
    goal = f"transform(array({node}), v -> named_struct('n', v.n, 'k', v.k, 'r', v.r, 'm', v.m, 'h', v.h, 'goal', {sure} * {total}.sum))"
    left = f"transform({goal}, v -> coalesce({found}.at, v.m))[0]"
    fold = f"""aggregate(q,
        named_struct('rest', total, 'room', (total * (mid - lo)) div (hi - lo), 'rooms', cast(array() as array<bigint>)),
        (s, x) -> named_struct('rest', s.rest - x.n, 'room', s.room - {left}, 'rooms', concat(s.rooms, array(s.room))),
        s -> concat(s.rooms, array(s.room)))"""
    nodes = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "q")
    for depth in range(math.ceil(math.log2(max(1, shards)))):
        if depth == SPREAD:
            nodes = nodes.repartition(F.col("lo"))
        nodes = nodes.withColumn("total", F.expr("aggregate(q, 0L, (a, x) -> a + x.n)"))
        nodes = nodes.withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2).cast("int"))
        # explode() of the single result keeps the fold from being evaluated once for each later use of it
        rooms = F.when(F.col("hi") - F.col("lo") > 1, F.array(F.expr(fold))).otherwise(F.array(F.array().cast("array<bigint>")))
        nodes = nodes.select("lo", "mid", "hi", "q", F.explode(rooms).alias("rooms"))
        left = F.expr("filter(transform(q, (x, k) -> named_struct('rank', x.rank, 'n', rooms[k] - rooms[k + 1])), x -> x.n > 0)")
        right = F.expr("filter(transform(q, (x, k) -> named_struct('rank', x.rank, 'n', x.n - rooms[k] + rooms[k + 1])), x -> x.n > 0)")
        halves = F.when(
            F.col("hi") - F.col("lo") > 1,
            F.array(
                F.struct(F.col("lo"), F.col("mid").alias("hi"), left.alias("q")),
                F.struct(F.col("mid").alias("lo"), F.col("hi"), right.alias("q")),
            ),
        ).otherwise(F.array(F.struct("lo", "hi", "q")))
        nodes = nodes.select(F.explode(halves).alias("x")).select("x.lo", "x.hi", "x.q")
    return nodes.select(F.col("lo").alias("shard"), F.explode("q").alias("x")).select("shard", "x.rank", F.col("x.n").alias("quota"))


def _carried(labelled: DataFrame, blocks: DataFrame, missing: DataFrame, fits: DataFrame) -> DataFrame:
    """(rank, block, doc_order) of documents outside the partial pass that fill the words a source still misses.

    Large ones first, by a fold over the counts of each size: what then is left is less than any document not taken.
    """
    units = labelled.filter("size > 0").join(missing.filter("left > 0"), "rank").filter("size <= left")
    units = units.join(blocks.filter("part < 2").select("rank", "block"), ["rank", "block"]).join(fits, ["rank", "block", "doc_order"], "left_anti")
    units = units.groupBy("rank", "block", "doc_order").agg(F.sum("size").alias("size"), F.first("left").alias("left"))
    units = stored(units.filter("size <= left"), "mix-rest")
    sizes = units.groupBy("rank", "size").agg(F.count("*").alias("n"), F.first("left").alias("left"))
    sizes = sizes.groupBy("rank").agg(F.first("left").alias("left"), F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("all"))
    fold = """aggregate(all, named_struct('left', left, 'on', cast(array() as array<struct<size:bigint,take:bigint>>)),
        (s, x) -> if(x.size <= s.left, named_struct('left', s.left - least(x.n, s.left div x.size) * x.size,
          'on', concat(s.on, array(named_struct('size', x.size, 'take', least(x.n, s.left div x.size))))), s), s -> s.on)"""
    takes = sizes.select("rank", F.explode(F.expr(fold)).alias("x")).select("rank", "x.size", "x.take")
    # The first of a size by order key, in two steps, so that no size is one task.
    picked = units.join(takes, ["rank", "size"]).withColumn("deal", F.pmod("doc_order", F.lit(256)))
    picked = picked.withColumn("place", F.row_number().over(Window.partitionBy("rank", "size", "deal").orderBy("doc_order"))).filter("place <= take")
    picked = picked.withColumn("place", F.row_number().over(Window.partitionBy("rank", "size").orderBy("doc_order"))).filter("place <= take")
    return picked.select("rank", "block", "doc_order")


def mix_draws(
    docs: DataFrame, weights=WEIGHTS, cap: int = MAX_PASSES, block_docs: int = 64, shard_words: int = 1 << 22, seed: int = 20240607,
) -> DataFrame:
    """Every document with size, source_size, target and ``draws``: array<struct<shard, pass, place>>, one per taking.

    ``docs`` needs ``source`` and ``text``; its other columns are kept. Sizes and blocks are computed from all rows.
    """
    sized = stored(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_key().alias("row_key")), "mix-sizes"
    )
    targets = stored(source_targets(sized, weights, cap), "mix-targets")
    words = targets.agg(F.sum("source_size").alias("w")).first()["w"] or 0
    shards = max(1, math.ceil(words / shard_words))
    blocks, labelled = _block_quotas(sized, targets, block_docs, seed)
    blocks = stored(blocks, "mix-blocks")

    # The exact number of block instances of each source: whole passes and the blocks of the partial pass.
    counts = blocks.groupBy("rank").agg(
        F.sum(F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0)).cast("long").alias("n"), F.count("*").alias("blocks")
    )
    quotas = counts.agg(F.sort_array(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "n"))).alias("q"))
    tree = _split_tree(quotas, shards, seed)
    upto = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    tree = tree.withColumn("first", F.coalesce(F.sum("quota").over(upto), F.lit(0)).cast("long")).filter("quota > 0")
    places = tree.select("rank", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("quota") - 1)).alias("ticket"))

    # Instance k of a source is pass k div blocks over the permuted blocks: shards draw disjoint runs of tickets.
    inst = blocks.join(counts.select("rank", F.col("blocks").alias("n_blocks")), "rank")
    inst = inst.withColumn("n_passes", F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0)).filter("n_passes > 0")
    inst = inst.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("n_passes") - 1)))
    inst = inst.withColumn("ticket", F.col("pass") * F.col("n_blocks") + F.col("place"))
    dealt = inst.join(places, ["rank", "ticket"]).groupBy("rank", "block").agg(
        F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("takes"), F.max("passes").alias("passes"),
        F.max("part").alias("part"), F.max("left").alias("left"),
    )

    # In the one boundary block of a source, documents that still fit are taken, large ones first; equal rows go together.
    edge = blocks.filter("part = 1").select("rank", "block", "left")
    edge_docs = labelled.join(edge, ["rank", "block"]).groupBy("rank", "block", "doc_order").agg(
        F.first("left").alias("left"), F.sum("size").alias("size")
    )
    edge_docs = edge_docs.groupBy("rank", "block").agg(
        F.first("left").alias("left"), F.sort_array(F.collect_list(F.struct("size", "doc_order")), asc=False).alias("all")
    )
    fit = """aggregate(all, named_struct('left', left, 'on', cast(array() as array<struct<size:bigint,doc_order:bigint>>)),
        (s, x) -> if(x.size > 0 and x.size <= s.left, named_struct('left', s.left - x.size, 'on', concat(s.on, array(x))), s))"""
    edge_docs = stored(edge_docs.select("rank", "block", F.expr(fit).alias("x")).select("rank", "block", "x.left", "x.on"), "mix-edge")
    fits = edge_docs.select("rank", "block", F.explode("on").alias("x")).select("rank", "block", "x.doc_order", F.lit(True).alias("fits"))
    # What is then still missing is carried to the source's other blocks; those documents go to the boundary block's shard.
    carried = _carried(labelled, blocks, edge_docs.select("rank", "left"), fits)
    shard = dealt.filter("part = 1").select("rank", F.expr("filter(takes, t -> t.pass = passes)[0]").alias("carry"))
    carried = carried.join(shard, "rank")
    out = labelled.join(dealt, ["rank", "block"], "left").join(fits, ["rank", "block", "doc_order"], "left")
    out = out.join(carried, ["rank", "block", "doc_order"], "left")
    whole = F.expr("filter(takes, t -> size > 0 and (t.pass < passes or part = 2 or (part = 1 and coalesce(fits, false))))")
    whole = F.coalesce(whole, F.array().cast("array<struct<pass:int,shard:int>>"))
    draws = F.transform(
        F.when(F.col("carry").isNotNull(), F.concat(whole, F.array("carry"))).otherwise(whole),
        lambda t: F.struct(t["shard"].alias("shard"), t["pass"].alias("pass"), F.xxhash64(F.lit(seed), F.lit("shuffle"), t["pass"], "doc_order").alias("place")),
    )
    return out.select("row_key", "doc_id", "source", "size", "source_size", "target", draws.alias("draws"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows themselves, all columns of ``docs``: one row per taking, laid out by shard, shuffled inside it."""
    key, draw = free_name(docs, "row_key"), free_name(docs, "draw")
    draws = mix_draws(docs, **options).filter("size(draws) > 0").select(F.col("row_key").alias(key), F.col("draws").alias(draw)).dropDuplicates([key])
    taken = docs.withColumn(key, row_key()).join(draws, key).withColumn(draw, F.explode(F.col(draw)))
    taken = taken.repartition(F.col(f"{draw}.shard")).sortWithinPartitions(f"{draw}.shard", f"{draw}.place")
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_mix_sources(spark, sf_dir):
    drawn = mix_draws(read(spark, sf_dir, "documents"))
    return drawn.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"),
        "source", F.transform("draws", lambda d: d["shard"]).alias("shards"),
    )
