"""The chunker as a table function for SQL: documents or sessions, told apart by their columns.

``SELECT * FROM chunk_text(TABLE(docs))`` cuts documents (id, text, and page_breaks if there are some);
``SELECT * FROM chunk_text(TABLE(segments) PARTITION BY session_id ORDER BY start)`` cuts sessions (session_id, start, text), whose
segments are read in the order given. A row is seen once; a session's text must fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from skein.operators.sentences import as_of, chunk_text


@dataclass
class Chosen(AnalyzeResult):
    """The output's schema, and which kind of rows came in."""

    key: str = "id"
    sessions: bool = False
    paged: bool = False


class ChunkText:
    @staticmethod
    def analyze(rows: AnalyzeArgument) -> Chosen:
        if not rows.isTable:
            raise ValueError("chunk_text takes a table argument: chunk_text(TABLE(...))")
        fields = {f.name: f.dataType for f in rows.dataType.fields}
        sessions = {"session_id", "start", "text"} <= set(fields)
        if not sessions and not {"id", "text"} <= set(fields):
            raise ValueError("chunk_text takes documents (id, text) or segments (session_id, start, text)")
        key = "session_id" if sessions else "id"
        schema = StructType().add(key, fields[key]).add("chunk_index", LongType()).add("text", StringType()).add("words", LongType())
        schema = schema.add("timestamp", DoubleType()) if sessions else schema.add("page_number", LongType())
        return Chosen(schema=schema, key=key, sessions=sessions, paged="page_breaks" in fields)

    def __init__(self, chosen: Chosen) -> None:
        self.chosen = chosen
        self.last, self.held = None, []

    def eval(self, rows: Row) -> Iterator[tuple]:
        if not self.chosen.sessions:
            starts = (list(rows["page_breaks"] or []) if self.chosen.paged else [0]) or []
            yield from self._chunks(rows["id"], rows["text"] or "", starts, list(range(1, len(starts) + 1)))
            return
        if self.held and rows["session_id"] != self.last:
            yield from self._session()
        self.last = rows["session_id"]
        self.held.append((rows["text"] or "", rows["start"]))

    def terminate(self) -> Iterator[tuple]:
        if self.held:
            yield from self._session()

    def _session(self) -> Iterator[tuple]:
        offsets, at = [], 0
        for text, _ in self.held:
            offsets.append(at)
            at += len(text) + 1
        joined, times = " ".join(t for t, _ in self.held), [None if s is None else float(s) for _, s in self.held]
        self.held = []
        yield from self._chunks(self.last, joined, offsets, times)

    @staticmethod
    def _chunks(key, text: str, offsets: list[int], values: list) -> Iterator[tuple]:
        for n, (chunk, first, words) in enumerate(chunk_text(text)):
            yield key, n, chunk, words, as_of(offsets, values, first)


def register(spark: SparkSession, name: str = "chunk_text") -> None:
    """Make the function known to SQL."""
    spark.udtf.register(name, udtf(ChunkText))
