"""Connected components of an edge table by distributed minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over ``edges`` (a, b), for every id in them.

    Each round takes the smallest of the labels of an id's neighbours and of its label's label (pre-aggregated before
    the shuffle), so that paths shrink geometrically. Labels are written to the shared folder between rounds.
    """
    edges = stored(edges.select("a", "b").filter("a <> b"), "cc-edges")
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "cc-labels")
    while True:
        # An id looks at its neighbours, at its label and at itself.
        looks = both.union(labels.filter("id <> component").select("id", "component")).union(labels.select("id", "id"))
        seen = looks.toDF("a", "b").join(labels, F.col("b") == labels["id"])
        own = F.max(F.when(F.col("a") == F.col("b"), F.col("component")))
        step = seen.groupBy("a").agg(F.min("component").alias("component"), own.alias("old")).withColumnRenamed("a", "id")
        step = stored(step, "cc-labels")
        labels = step.select("id", "component")
        if step.filter("component <> old").limit(1).count() == 0:
            return labels
