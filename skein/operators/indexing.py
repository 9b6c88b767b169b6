"""The index of documents and sessions as a versioned table of chunks: rebuilt whole, or item by item, failures listed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.batches import map_batches
from skein.operators.embedding import hashed_embedding
from skein.operators.sentences import Chunker, as_of, chunk_text
from skein.sources.shared import stored
from skein.sources.versions import VersionedTable

KEYS = ["source_type", "source_id"]
ITEM = "source_type string, source_id long"
CHUNK = f"{ITEM}, chunk_index long, text string, words long, page_number long, timestamp double, vector array<float>"


def document_items(docs: DataFrame) -> DataFrame:
    """Documents (id, text, and page_breaks where there are some) as items."""
    breaks = F.col("page_breaks").cast("array<bigint>") if "page_breaks" in docs.columns else F.array(F.lit(0).cast("long"))
    times = F.lit(None).cast("array<double>")
    return docs.select(F.lit("document").alias("source_type"), F.col("id").cast("long").alias("source_id"), F.array(F.coalesce("text", F.lit(""))).alias("parts"), breaks.alias("starts"), times.alias("times"))


def session_items(segments: DataFrame) -> DataFrame:
    """Sessions of segments (session_id, start, text) as items; sessions without segments are none."""
    ordered = segments.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("start", F.coalesce("text", F.lit("")).alias("text")))).alias("s"))
    return ordered.select(
        F.lit("session").alias("source_type"), F.col("session_id").cast("long").alias("source_id"), F.col("s.text").alias("parts"), F.lit(None).cast("array<bigint>").alias("starts"),
        F.col("s.start").cast("array<double>").alias("times"),
    )


def chunked(items: DataFrame, provider: Callable[[str], np.ndarray | None] = hashed_embedding, chunker: Chunker = chunk_text) -> DataFrame:
    """Chunks of items with their vectors; and for each item a row without chunk_index: ``error`` says why it failed, or is null.

    An item fails as a whole where the chunker or the provider raises on any part of it: none of its chunks are there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                out: list[tuple] = []
                for kind, key, parts, starts, times in zip(*(c.to_pylist() for c in batch.slice(lo, 128).columns), strict=True):
                    try:
                        out += item(kind, key, parts, starts, times)
                        out.append((kind, key) + (None,) * 7)
                    except Exception as failed:  # noqa: BLE001  whatever a provider raises concerns its item alone
                        out.append((kind, key) + (None,) * 6 + (f"{type(failed).__name__}: {failed}",))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def item(kind: str, key: int, parts: list[str], starts: list[int] | None, times: list[float] | None) -> list[tuple]:
        offsets, at = [], 0
        for p in parts:
            offsets.append(at)
            at += len(p) + 1
        rows = []
        for n, (chunk, first, words) in enumerate(chunker(" ".join(parts))):
            v = provider(chunk)
            page = as_of(starts, list(range(1, len(starts) + 1)), first) if starts else None
            when = as_of(offsets, times, first) if times else None
            rows.append((kind, key, n, chunk, words, page, when, None if v is None else np.asarray(v, np.float32), None))
        return rows

    names = ["source_type", "source_id", "chunk_index", "text", "words", "page_number", "timestamp", "vector", "error"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float32()), pa.string()]
    return map_batches(items.select("source_type", "source_id", "parts", "starts", "times"), run, f"{CHUNK}, error string")


class ChunkIndex:
    """Chunks of all items in a versioned table below ``path``."""

    def __init__(self, table: VersionedTable, provider: Callable[[str], np.ndarray | None] = hashed_embedding, chunker: Chunker = chunk_text) -> None:
        self.table, self.provider, self.chunker = table, provider, chunker

    @classmethod
    def at(cls, spark, path: str, buckets: int = 16, **how) -> ChunkIndex:
        return cls(VersionedTable(spark, path, KEYS, buckets), **how)

    def _made(self, items: DataFrame) -> tuple[DataFrame, DataFrame]:
        made = stored(chunked(items, self.provider, self.chunker), "chunked")
        status = F.when(F.col("error").isNull(), "ready").otherwise("failed").alias("status")
        return made.filter("chunk_index is not null").drop("error"), made.filter("chunk_index is null").select(*KEYS, status, "error")

    def rebuild(self, *items: DataFrame, token: tuple[str, int] | None = None) -> DataFrame:
        """All items indexed anew, in one commit that readers see at once: source_type, source_id, status, error of each. Failing ones have no chunks."""
        every = items[0]
        for more in items[1:]:
            every = every.unionByName(more)
        chunks, statuses = self._made(every)
        self.table.overwrite(chunks, token)
        return statuses

    def index(self, items: DataFrame, token: tuple[str, int] | None = None) -> DataFrame:
        """These items indexed anew: their old chunks go, also those of failing ones; a batch that comes again changes nothing."""
        chunks, statuses = self._made(items)
        self.table.replace(chunks, statuses, token)
        return statuses

    def remove(self, keys: DataFrame, token: tuple[str, int] | None = None) -> None:
        self.table.delete(keys, token)
