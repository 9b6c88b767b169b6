"""A vector store over a frame: upsert, remove, count and search as functions to new stores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.retrieval import vector_top_k


@dataclass(frozen=True)
class VectorStore:
    """Rows (id, vector)."""

    rows: DataFrame

    def upsert(self, fresh: DataFrame) -> VectorStore:
        """Fresh rows replace those of equal id."""
        kept = self.rows.join(fresh.select("id").distinct(), "id", "left_anti")
        return VectorStore(kept.unionByName(fresh))

    def remove(self, ids: DataFrame) -> VectorStore:
        return VectorStore(self.rows.join(ids.select("id").distinct(), "id", "left_anti"))

    def clear(self) -> VectorStore:
        return VectorStore(self.rows.filter(F.lit(False)))

    def count(self) -> DataFrame:
        return self.rows.agg(F.count("*").alias("vectors"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return vector_top_k(queries, self.rows, k)
