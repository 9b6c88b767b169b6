"""Import of raw files: dispatch by extension, decoding, cleaning, guards; and the scans of stored tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text

TEXT_LIMIT = 5 * 1024 * 1024
PDF_LIMIT = 50 * 1024 * 1024


def file_type(path: Column) -> Column:
    """txt, md or pdf by extension; null for all others."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.lower(F.when(name.contains("."), F.element_at(F.split(name, "[.]"), -1)))
    return F.when(ext.isin("txt", "text"), "txt").when(ext.isin("md", "markdown"), "md").when(ext == "pdf", "pdf")


def import_error(kind: Column, raw_bytes: Column, body: Column) -> Column:
    """Why a file is rejected; null if it is not."""
    limit = F.when(kind == "pdf", F.lit(PDF_LIMIT)).otherwise(F.lit(TEXT_LIMIT))
    return (
        F.when(kind.isNull(), "unsupportedType")
        .when(raw_bytes > limit, "tooLarge")
        .when(F.octet_length(F.coalesce(body, F.lit(""))) > TEXT_LIMIT, "tooLarge")
        .when(text.strip(F.coalesce(body, F.lit(""))) == "", "empty")
    )


def looks_scanned(pages: Column) -> Column:
    """Fewer characters than 50 and than ten a page."""
    total = F.aggregate(pages, F.lit(0).cast("long"), lambda s, p: s + F.length(p))
    return total < F.greatest(F.lit(50), F.size(pages) * 10)


def _fallback(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Windows code page 1252, else Latin-1."""

    def one(b):
        if b is None:
            return None
        try:
            return bytes(b).decode("cp1252")
        except UnicodeDecodeError:
            return bytes(b).decode("latin-1")

    for s in blobs:
        yield s.map(one)


def decode(content: Column) -> Column:
    """UTF-8 where valid, else the fallback."""
    as_text = content.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.pandas_udf(_fallback, "string")(content))


def import_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, file_type, text, import_error of all files below a folder (pdf bytes need a page parser and stay without text)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    kind = file_type(F.col("path"))
    body = F.when(kind != "pdf", text.clean(decode(F.col("content"))))
    rows = raw.select("path", kind.alias("file_type"), F.col("length"), body.alias("text"))
    error = F.when(F.col("file_type") == "pdf", F.lit("needsPageParser")).otherwise(import_error(F.col("file_type"), F.col("length"), F.col("text")))
    return rows.select("path", "file_type", "text", error.alias("import_error"))


def import_pages(rows: DataFrame, key: str) -> DataFrame:
    """key, text, page_breaks, page_count, import_error of paged files: (key, length, pages array<struct<page_number,text>>).

    The pages are what a parser made of the file's bytes: null for files it can't read, and cleaned here one by one.
    They are joined by blank lines in page order, with the offset at which each begins; files that look scanned, are
    too large or have no text are rejected.
    """
    cleaned = F.transform(F.array_sort("pages"), lambda p: text.clean(F.coalesce(p["text"], F.lit(""))))
    made = rows.select(key, "length", cleaned.alias("pages"))
    error = (
        F.when(F.col("pages").isNull(), "unreadable").when(F.col("length") > PDF_LIMIT, "tooLarge")
        .when((F.size("pages") > 0) & looks_scanned(F.col("pages")), "scanned").when(F.octet_length("text") > TEXT_LIMIT, "tooLarge")
        .when(text.strip(F.col("text")) == "", "empty")
    )
    joined = text.join_pages(F.col("pages"))
    made = made.select(key, "length", "pages", joined["text"].alias("text"), joined["offsets"].alias("page_breaks"))
    return made.select(key, "text", "page_breaks", F.size("pages").alias("page_count"), error.alias("import_error"))


def catalogue(models: DataFrame, asked: DataFrame) -> DataFrame:
    """ask_id, model_id: for each row (ask_id, kind, wanted) the model (model_id, kind, is_default) that is wanted, if its kind has it, or
    else the kind's default one (of several the first); null for kinds without models."""
    held = models.select(F.col("kind").alias("__kind"), "model_id")
    default = models.filter("is_default").groupBy(F.col("kind").alias("__kind")).agg(F.min("model_id").alias("default"))
    exact = asked.join(held, (F.col("kind") == F.col("__kind")) & (F.col("wanted") == F.col("model_id")), "left").drop("__kind")
    return exact.join(default, F.col("kind") == F.col("__kind"), "left").select("ask_id", F.coalesce("model_id", "default").alias("model_id"))


# Scans: filters and orders are left to the reader's pushdown and the planner's top-n.


def newest_first(rows: DataFrame, created: str, key: str, limit: int | None = None) -> DataFrame:
    ordered = rows.orderBy(F.desc(created), key)
    return ordered if limit is None else ordered.limit(limit)


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.filter(F.col(key) == value).limit(1)


def by_keys(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def generated_segments(texts: DataFrame, seconds: float = 6.0) -> DataFrame:
    """session_id, segment_id, start, end, text: a transcript of each text (id, text), a line a segment, at even intervals; blank lines are silence."""
    lines = texts.select(F.col("id").alias("session_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("segment_id", "text"))
    start = F.col("segment_id") * F.lit(seconds)
    return lines.filter(text.strip(F.col("text")) != "").select("session_id", F.col("segment_id").cast("long").alias("segment_id"), start.alias("start"), (start + seconds).alias("end"), "text")

