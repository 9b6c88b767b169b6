"""Ranked-retrieval evaluation: recall at k, reciprocal rank, hit rate, self-retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 6)) -> DataFrame:
    """query_id, relevant, recall_<k>, rr: of ranked (query_id, id, position) against relevant (query_id, id).

    Queries without relevant rows are unlabelled: their metrics are null.
    """
    total = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("relevant"))
    return _outcomes(ranked, total, ranked.join(relevant.distinct(), ["query_id", "id"]), ks)


def per_query_by_label(ranked: DataFrame, asked: DataFrame, rows: DataFrame, ks: tuple[int, ...] = (1, 3, 6)) -> DataFrame:
    """``per_query`` where the relevant rows (id, label) are those that share a label with the query (query_id, label).

    Rows are counted by their sets of labels, so that the pairs of queries and relevant rows are never made.
    """
    labelled = lambda df, key: df.filter("label is not null").groupBy(key).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    own, members = labelled(asked, "query_id").withColumnRenamed("labels", "wanted"), labelled(rows, "id")
    sizes = members.groupBy("labels").agg(F.count("*").alias("n")).withColumn("label", F.explode("labels"))
    shared = own.select("wanted").distinct().withColumn("label", F.explode("wanted")).join(sizes, "label").dropDuplicates(["wanted", "labels"])
    total = own.join(shared.groupBy("wanted").agg(F.sum("n").alias("relevant")), "wanted").select("query_id", "relevant")
    return _outcomes(ranked, total, ranked.join(members, "id").join(own, "query_id").filter(F.arrays_overlap("labels", "wanted")), ks)


def _outcomes(ranked: DataFrame, total: DataFrame, found: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Metrics from the numbers of relevant rows (query_id, relevant) and those ranked rows that are relevant."""
    hits = found.groupBy("query_id").agg(*[F.count(F.when(F.col("position") <= k, 1)).alias(f"hit_{k}") for k in ks], F.min("position").alias("first"))
    asked = ranked.select("query_id").union(total.select("query_id")).distinct()
    joined = asked.join(total, "query_id", "left").join(hits, "query_id", "left")
    labelled = F.col("relevant").isNotNull()
    return joined.select(
        "query_id", F.coalesce("relevant", F.lit(0)).alias("relevant"),
        *[F.when(labelled, F.coalesce(F.col(f"hit_{k}"), F.lit(0)) / F.col("relevant")).alias(f"recall_{k}") for k in ks],
        F.when(labelled, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("rr"),
    )


def summary(outcomes: DataFrame, ks: tuple[int, ...] = (1, 3, 6)) -> DataFrame:
    """Means over labelled queries, their number, and the unlabelled ones."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return outcomes.agg(
        *[mean(f"recall_{k}").alias(f"recall_{k}") for k in ks], mean("rr").alias("mrr"),
        F.count("rr").alias("labelled"), F.count(F.when(F.col("rr").isNull(), 1)).alias("unlabelled"),
    )
