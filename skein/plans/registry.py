"""Registry of the queries that exercise the reference's operators, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Midnight of 2024-01-01; synthetic dates count from here.
EPOCH = 1704067200
NOW = EPOCH + 90 * 86400


class Tables:
    """The driver's tables, and the sessions, segments and corpus that stand on them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def docs(self) -> DataFrame:
        """documents with id and a creation time in epoch seconds, an hour apart."""
        return self.documents.withColumn("id", F.col("doc_id")).withColumn("created", (F.lit(EPOCH) + F.col("doc_id") * 3600).cast("long"))

    @cached_property
    def sessions(self) -> DataFrame:
        """One session a conversation: the first turn's opening is its title, six seconds a turn."""
        grouped = self.conversations.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.count("*").alias("turns"))
        return grouped.select(
            F.col("conv_id").alias("session_id"), F.left(F.coalesce("first", F.lit("")), F.lit(40)).alias("title"),
            (F.lit(EPOCH) + F.col("conv_id") * 86400).cast("long").alias("created"), (F.col("turns") * 6.0).alias("duration"), "turns",
        )

    @cached_property
    def segments(self) -> DataFrame:
        return self.conversations.select(
            F.col("conv_id").alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("segment_id"),
            (F.col("turn") * 6.0).alias("start"), (F.col("turn") * 6.0 + 6.0).alias("end"), "text", F.col("role").alias("speaker"), "turn",
        )

    @cached_property
    def corpus(self) -> DataFrame:
        """All documents, with their vector and label where they have one (vec_id = doc_id)."""
        v = self.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
        return self.docs.join(v, "id", "left").select("id", "text", "vector", "created", "label", "source")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")

    @cached_property
    def asked(self) -> DataFrame:
        """The stated query set: every corpus row whose id is divisible by 100."""
        return self.corpus.filter(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "text", "vector")


#: The same frames for DuckDB.
SQL_FRAMES = {
    "docs": f"docs AS (SELECT *, doc_id AS id, {EPOCH} + doc_id * 3600 AS created FROM documents)",
    "sessions": f"""sessions AS (SELECT conv_id AS session_id, left(coalesce(first, ''), 40) AS title, {EPOCH} + conv_id * 86400 AS created,
        turns * 6.0::DOUBLE AS duration, turns FROM (SELECT conv_id, min_by(text, turn) AS first, count(*) AS turns FROM conversations GROUP BY conv_id))""",
    "segments": """segments AS (SELECT conv_id AS session_id, conv_id * 1000 + turn AS segment_id, turn * 6.0::DOUBLE AS start,
        turn * 6.0::DOUBLE + 6.0::DOUBLE AS "end", text, role AS speaker, turn FROM conversations)""",
    "corpus": f"""corpus AS (SELECT doc_id AS id, text, embedding::DOUBLE[] AS vector, {EPOCH} + doc_id * 3600 AS created, label, source
        FROM documents LEFT JOIN embeddings ON vec_id = doc_id)""",
    "updates": """updates AS (SELECT conv_id::VARCHAR AS session_id, (turn * 4 + k)::BIGINT AS seq, CASE WHEN k < 2 THEN left(x, (length(x) // 2)::INT) ELSE x END AS text, k > 0 AS is_final,
        turn * 6.0::DOUBLE AS start, turn * 6.0::DOUBLE + 6 AS "end" FROM (SELECT conv_id, turn, coalesce(text, '') AS x, unnest([0, 1, 2, 3]) AS k FROM conversations))""",
    "vectors": "vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector, label FROM embeddings)",
}


def register(name: str, sql: str | None = None, frames: str = ""):
    """Register a query of ``Tables``; ``frames`` names the shared frames that its SQL uses."""

    def keep(work: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: work(Tables(spark, sf_dir))
        if sql is not None:
            shared = [SQL_FRAMES[f] for f in frames.split()]
            body = sql.strip()
            if shared:
                recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
                rest = body[len("WITH RECURSIVE ") :] if recursive else body[len("WITH ") :] if body.upper().startswith("WITH ") else ""
                body = f"WITH {recursive}" + ", ".join(shared) + (f", {rest}" if rest else f" {body}")
            ORACLES[name] = body
        return work

    return keep


def _load() -> None:
    for module in ("scalars", "relational", "storage", "search"):
        import_module(f"skein.plans.{module}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(ORACLES)
