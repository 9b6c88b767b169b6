"""Joins, aggregates and windows that other operators don't own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text
from skein.operators.scans import following, numbered


def resolve_citations(refs: DataFrame, chunks: DataFrame, titles: DataFrame, default: str) -> DataFrame:
    """References with the title of their source and where in it they point."""
    joined = refs.join(chunks, "chunk_id", "left").join(titles, "source_id", "left")
    detail = F.when(F.col("page_number").isNotNull(), F.concat(F.lit("Page "), F.col("page_number").cast("string")))
    if "timestamp" in chunks.columns:
        detail = F.coalesce(detail, text.clock(F.col("timestamp")))
    return joined.withColumn("detail", detail).withColumn("title", F.coalesce("title", F.lit(default)))


def of_type(rows: DataFrame, column: str, kind: str) -> DataFrame:
    """Rows of a polymorphic table that point to one type; the filter reaches the scan."""
    return rows.filter(F.col(column) == kind)


def as_of(rows: DataFrame, marks: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Each row with the value of the key's last mark not after it: one sort-and-scan over the union of both."""
    both = rows.withColumn("__v", F.lit(None).cast(marks.schema[value].dataType)).withColumn("__row", F.lit(1)).unionByName(
        marks.select(key, ts, F.col(value).alias("__v")).withColumn("__row", F.lit(0)), allowMissingColumns=True
    )
    order = Window.partitionBy(key).orderBy(ts, "__row").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(order)).filter("__row = 1").drop("__v", "__row")


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; pre-aggregated before the shuffle."""
    others = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r"))
    return first.select(key, "r.*")


def counts(frames: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each frame."""
    parts = [df.select(F.lit(name).alias("name")) for name, df in frames.items()]
    total = reduce(DataFrame.unionAll, parts)
    return total.agg(*[F.count(F.when(F.col("name") == name, 1)).alias(name) for name in frames])


def storage_usage(transcripts: DataFrame, documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """Bytes by class and in all; vectors count four bytes a component."""
    parts = [
        transcripts.select(F.lit("transcripts").alias("c"), F.octet_length("text").cast("long").alias("n")),
        documents.select(F.lit("documents").alias("c"), F.octet_length("text").cast("long").alias("n")),
        vectors.select(F.lit("index_bytes").alias("c"), (F.size("embedding") * 4).cast("long").alias("n")),
    ]
    sums = reduce(DataFrame.unionAll, parts).agg(*[F.sum(F.when(F.col("c") == c, F.col("n"))).alias(c) for c in ("transcripts", "documents", "index_bytes")])
    return sums.withColumn("total", F.col("transcripts") + F.col("documents") + F.col("index_bytes"))


def by_category(rows: DataFrame) -> DataFrame:
    """Counts by category, ascending, the ungrouped last."""
    grouped = rows.groupBy(F.coalesce("category", F.lit("Ungrouped")).alias("category")).agg(F.count("*").alias("n"))
    return grouped.orderBy(F.col("category") == "Ungrouped", "category")


def metric_means(rows: DataFrame) -> DataFrame:
    """Means over labelled queries only (nulls are unlabelled); 0 where there are none."""
    return rows.agg(F.round(F.coalesce(F.avg("recall"), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(F.avg("rr"), F.lit(0.0)), 6).alias("mrr"))


def hit_rate(rows: DataFrame) -> DataFrame:
    """Share of hits and the missed query ids."""
    misses = F.sort_array(F.collect_list(F.when(~F.col("hit"), F.col("query_id"))))
    return rows.agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"), misses.alias("misses"))


def first_appearance(rows: DataFrame, key: str, value: str, position: str, prefix: str) -> DataFrame:
    """Values numbered in the order in which they first appear within a key."""
    first = rows.groupBy(key, value).agg(F.min(position).alias("__at"))
    n = F.dense_rank().over(Window.partitionBy(key).orderBy("__at"))
    return first.withColumn("label", F.concat(F.lit(prefix), n.cast("string"))).drop("__at")


def citation_order(cited: Column, n: Column) -> Column:
    """Valid numbers once each, in order; all passages where none is valid."""
    valid = F.array_distinct(F.filter(cited, lambda x: x.between(F.lit(1), n)))
    return F.when(F.size(valid) == 0, F.sequence(F.lit(1), n)).otherwise(valid)


def relation_to_previous(now: Column, before: Column) -> Column:
    a, b = F.lower(now), F.lower(before)
    return F.when(before.isNull(), "append").when(F.startswith(a, b), "extends").when(F.startswith(b, a), "repeats").otherwise("append")


def update_stream(turns: DataFrame) -> DataFrame:
    """Conversation turns as transcription updates: each turn is heard half, then whole, then again."""
    base = turns.select(F.col("conv_id").cast("string").alias("session_id"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    half = F.left(F.col("text"), F.floor(F.length("text") / 2).cast("int"))
    heard = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), body.alias("text"), F.lit(final).alias("is_final")) for k, body, final in ((0, half, False), (1, half, True), (2, F.col("text"), True), (3, F.col("text"), True))]))
    return base.select("session_id", "turn", heard.alias("h")).select(
        "session_id", (F.col("turn") * 4 + F.col("h.k")).cast("long").alias("seq"), F.col("h.text").alias("text"), F.col("h.is_final").alias("is_final"),
        (F.col("turn") * 6.0).alias("start"), (F.col("turn") * 6.0 + 6.0).alias("end"),
    )


def active_time(events: DataFrame, key: str, ts: str, tie: str, running: Column) -> DataFrame:
    """Seconds during which each key ran: from each running event to the next event. A key's events may span many tasks."""
    rows = numbered(events.select(key, F.col(ts).cast("timestamp").alias("ts"), F.col(tie).alias("tie"), running.alias("running")), key, ["ts", "tie"])
    gap = F.coalesce((F.unix_micros("next") - F.unix_micros("ts")) / F.lit(1e6), F.lit(0.0))
    found = following(rows, key, "ts", "next")
    return found.groupBy(key).agg(F.round(F.sum(F.when(F.col("running"), gap).otherwise(0.0)), 3).alias("active"))


def split_pages(rows: DataFrame, key: str) -> DataFrame:
    """key, off, page of (key, text, breaks): the text between adjacent break offsets."""
    cuts = rows.select(key, "text", F.explode("breaks").alias("off"))
    following = F.lead("off").over(Window.partitionBy(key).orderBy("off"))
    page = F.substr(F.col("text"), F.col("off") + 1, F.coalesce("nxt", F.length("text")) - F.col("off"))
    return cuts.withColumn("nxt", following).filter(F.col("off") < F.length("text")).select(key, F.col("off").cast("long").alias("off"), page.alias("page"))


def ends(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first and the last ``n`` of each key, by window ranks (only those rows are gathered)."""
    up = F.row_number().over(Window.partitionBy(key).orderBy(order))
    down = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    ranked = rows.select(key, order, up.alias("u"), down.alias("d")).filter((F.col("u") <= n) | (F.col("d") <= n))
    kept = lambda c: F.sort_array(F.collect_list(F.when(F.col(c) <= n, F.col(order))))
    return ranked.groupBy(key).agg(kept("u").alias("first_three"), kept("d").alias("last_three"))
