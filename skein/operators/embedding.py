"""Embedding providers and the index build: chunk, embed, normalise."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.batches import map_batches
from skein.operators.sentences import CHUNK_FIELDS, Chunker, chunk_batch, chunk_text

DIMENSION = 64
#: Words whose places a worker remembers.
WORDS = 1 << 15


@lru_cache(maxsize=WORDS)
def _place(word: str) -> tuple[int, float]:
    h = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(h[:4], "little") % DIMENSION, 1.0 if h[4] & 1 else -1.0


def hashed_embedding(text: str) -> np.ndarray | None:
    """The default provider: signed feature hashing of words, unit length; none for texts without words."""
    sums = [0.0] * DIMENSION
    for k, sign in map(_place, text.lower().split()):
        sums[k] += sign
    v = np.array(sums)
    n = np.linalg.norm(v)
    return v / n if n > 1e-6 else None


def _vectors(texts: pa.Array, provider: Callable[[str], np.ndarray | None]) -> pa.Array:
    made = [None if t is None else provider(t) for t in texts.to_pylist()]
    return pa.array([None if v is None else v.astype(np.float32) for v in made], pa.list_(pa.float32()))


def embed(rows: DataFrame, provider: Callable[[str], np.ndarray | None] = hashed_embedding) -> DataFrame:
    """``rows`` with a vector of each text (null where the provider has none); any provider from text to vector serves."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _vectors(batch.column(batch.schema.get_field_index("text")), provider)
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], [*batch.schema.names, "vector"])

    return map_batches(rows, run, f"{fields}, vector array<float>")


def index_documents(docs: DataFrame, provider: Callable[[str], np.ndarray | None] = hashed_embedding, chunker: Chunker = chunk_text) -> DataFrame:
    """id, chunk_index, text, words, page_number, vector of documents (id, text): chunked and embedded in one step, without a shuffle."""
    if "page_breaks" not in docs.columns:
        docs = docs.withColumn("page_breaks", F.array(F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                row, columns = chunk_batch(part, chunker)
                names = ["id", "chunk_index", "text", "words", "page_number", "vector"]
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), *columns, _vectors(columns[1], provider)], names)

    kind = docs.schema["id"].dataType.simpleString()
    return map_batches(docs.select("id", "text", F.col("page_breaks").cast("array<bigint>")), run, f"id {kind}, {CHUNK_FIELDS}, vector array<float>")
