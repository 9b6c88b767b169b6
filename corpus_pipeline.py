"""The corpus pipeline: toxicity, near-duplicates, personal data, source mixing, SentencePiece encoding.

Each stage takes all that its predecessor kept and returns it changed; all but the last return the columns of
``documents``. ``run`` writes each stage's rows as Parquet in the shared folder, reads them again for the next, and
then removes what the stage and its predecessor left there.
No stage can be put as SQL that gives equal rows (a trained classifier, similarity components, keyed permutations),
so ORACLE_SQL is None and tests/llm/test_pipeline.py compares the stages with plain Python versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import mixing, near_dups, pieces, pii, toxicity
from skein.llm.common import read
from skein.sources.shared import recorded, remove, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on these documents and the labels, does not reject."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return near_dups.drop_near_duplicates(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms; n_chars follows the new text."""
    made = pii.pseudonymise(docs)
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, in shards, shuffled."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded rows, with parity and round-trip checks."""
    return pieces.encode_summary(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", pseudonymise),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with recorded() as left:
            path = scratch(spark, f"pipeline-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        remove(spark, before + [p for p in left if p != path])
        before = [path]
    return docs
