"""Sentence splitting, whole or incremental, and chunking of documents and transcripts."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words whose dot ends no sentence.
TITLES = frozenset("mr mrs ms dr prof sr jr st vs etc no fig al approx".split())
CLOSERS = "\"')”"
END = re.compile(rf"[.!?](?=[{CLOSERS}]*(?:[ \n]|\Z))")
LAST_WORD = re.compile(r"[^\W\d_]*\Z")

CHUNK_WORDS, LONG_SENTENCE, OVERLAP_WORDS = 200, 300, 40


def _ends_here(text: str, at: int) -> bool:
    """Whether the terminator at ``at`` ends a sentence."""
    if text[at] != ".":
        return True
    if at >= 2 and text[at - 2] == ".":
        return False
    word = LAST_WORD.search(text, max(0, at - 40), at)[0]
    return not (len(word) == 1 and word.isupper()) and word.lower() not in TITLES


def completed(text: str, consumed: int) -> tuple[list[str], int]:
    """Sentences that end after ``consumed`` and are followed by more text, and how far the text is consumed then."""
    found, start = [], consumed
    for m in END.finditer(text, consumed):
        if m.end() < len(text) and _ends_here(text, m.start()):
            sentence = text[start : m.end()].strip()
            start = m.end()
            if sentence:
                found.append(sentence)
    return found, start


def split_sentences(text: str) -> list[tuple[str, int]]:
    """All sentences with their offsets; line ends are sentence ends too, and the rest is the last sentence."""
    out = []
    at = 0
    for line in text.split("\n"):
        start = 0
        cuts = [m.end() for m in END.finditer(line) if _ends_here(line, m.start())]
        for cut in [*cuts, len(line)]:
            part = line[start:cut]
            if part.strip():
                out.append((part.strip(), at + start + len(part) - len(part.lstrip())))
            start = cut
        at += len(line) + 1
    return out


def chunk_text(text: str, size: int = CHUNK_WORDS, longest: int = LONG_SENTENCE, overlap: int = OVERLAP_WORDS) -> list[tuple[str, int, int]]:
    """(chunk, offset of its first sentence, words): whole sentences up to ``size`` words, the next chunk starting some
    whole sentences back until these make ``overlap`` words; sentences over ``longest`` words are cut into pieces."""
    units: list[tuple[str, int, int]] = []
    for sentence, at in split_sentences(text):
        words = sentence.split()
        if len(words) > longest:
            units += [(" ".join(words[k : k + size]), at, len(words[k : k + size])) for k in range(0, len(words), size)]
        elif words:
            units.append((sentence, at, len(words)))
    out, start = [], 0
    while start < len(units):
        end, words = start, 0
        while end < len(units) and (end == start or words + units[end][2] <= size):
            words += units[end][2]
            end += 1
        out.append((" ".join(u[0] for u in units[start:end]), units[start][1], words))
        if end >= len(units):
            break
        back, kept = end, 0
        while back > start + 1 and kept < overlap:
            back -= 1
            kept += units[back][2]
        start = max(back, start + 1)
    return out


def as_of(offsets: list[int], values: list, at: int):
    """The value of the last offset not beyond ``at``; before the first, the first; none if there are none."""
    if not offsets:
        return None
    return values[max(0, bisect_right(offsets, at) - 1)]


#: (text) -> (chunk, offset of its first sentence, words) of each chunk, in order.
Chunker = Callable[[str], list[tuple[str, int, int]]]
CHUNKS = "array<struct<chunk_index:bigint,text:string,words:bigint,page_number:bigint,timestamp:double>>"


def chunk_batch(batch: pa.RecordBatch, chunker: Chunker) -> tuple[pa.Array, list[pa.Array]]:
    """Chunks of a batch (id, text, page start offsets): the row each belongs to, and chunk_index, text, words, page_number."""
    rows, out = [], []
    texts, breaks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
    for k, (text, starts) in enumerate(zip(texts, breaks, strict=True)):
        starts = starts or []
        pages = list(range(1, len(starts) + 1))
        made = [(n, c, words, as_of(starts, pages, at)) for n, (c, at, words) in enumerate(chunker(text or ""))]
        rows += [k] * len(made)
        out += made
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
    columns = zip(*out, strict=True) if out else ((),) * 4
    return pa.array(rows, pa.int64()), [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]


def _chunk_segments(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Chunks of a session's ordered (segment texts, segment starts); each has the time of its first sentence's segment."""
    for texts, starts in parts:
        out = []
        for own, times in zip(texts, starts, strict=True):
            own = [] if own is None else [x or "" for x in own]
            offsets, at = [], 0
            for x in own:
                offsets.append(at)
                at += len(x) + 1
            out.append([
                {"chunk_index": k, "text": c, "words": n, "page_number": None, "timestamp": as_of(offsets, list(times), a)}
                for k, (c, a, n) in enumerate(chunk_text(" ".join(own)))
            ])
        yield pd.Series(out)


def _sentences(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Sentences of cumulative text, the trailing one included."""
    for s in texts:
        out = []
        for t in s:
            found, at = completed(t or "", 0)
            tail = (t or "")[at:].strip()
            out.append(found + ([tail] if tail else []))
        yield pd.Series(out)


def chunk_segments(texts, starts) -> Column:
    return F.pandas_udf(_chunk_segments, CHUNKS)(texts, starts)


def sentences(text) -> Column:
    return F.pandas_udf(_sentences, "array<string>")(text)


#: Columns of a chunk beside the document's id.
CHUNK_FIELDS = "chunk_index long, text string, words long, page_number long"


def chunk_documents(docs: DataFrame, chunker: Chunker = chunk_text) -> DataFrame:
    """id, chunk_index, text, words, page_number of documents (id, text, page_breaks); any chunker serves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, columns = chunk_batch(batch, chunker)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), *columns], ["id", "chunk_index", "text", "words", "page_number"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text", F.col("page_breaks").cast("array<bigint>")).mapInArrow(run, f"id {kind}, {CHUNK_FIELDS}")


def chunk_sessions(segments: DataFrame) -> DataFrame:
    """session_id, chunk_index, text, words, timestamp of segments (session_id, start, text)."""
    ordered = segments.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("s"))
    made = ordered.select("session_id", F.explode(chunk_segments(F.col("s.text"), F.col("s.start"))).alias("c"))
    return made.select("session_id", "c.chunk_index", "c.text", "c.words", "c.timestamp")
