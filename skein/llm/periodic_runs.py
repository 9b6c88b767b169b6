r"""Periodic runs of words in whole texts, by the runs theorem, and texts without their repeats.

Words are maximal stretches of anything but ASCII white space, compared exactly. A run is a stretch of words with
smallest period q (words q apart are identical), at least max(``least``, ``power`` * q) long, that neither neighbour extends.

Each text's words become numbers; many texts are laid end to end and share one suffix array, inverse and LCP array.
The longest Lyndon word at each place, under an order of the words and under its reverse, ends before the next smaller
(or larger) value of the inverse suffix array. Each run has such Lyndon words as roots, one period apart. Roots whose common extension to the
right (a range minimum over the LCP array) can belong to a run are extended to the left in the same way, with the
arrays of the reversed text; the leftmost root gives the run.

Texts are handled one by one inside the tasks that read them: nothing is shuffled or gathered. Memory is about 150
bytes for each word of the longest text. Null and empty texts, and texts of white space alone, have no words, no runs and
an empty collapsed text. Equal rows give equal results; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import WORD, map_batches, read, word_count
from skein.llm.suffixes import Suffixes, next_smaller

#: Texts are laid end to end up to so many words; a longer text stands alone.
SLICE = 1 << 15
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_PIECE = 1 << 20


class _Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_numbers(text: str | None) -> tuple[np.ndarray, list[bytes]]:
    """A text's words as numbers, and the words by number."""
    data, names, parts, lo = (text or "").encode("utf-8", "surrogatepass"), _Numbers(), [], 0
    while lo < len(data):
        gap = _GAP.search(data, lo + _PIECE)
        hi = gap.start() if gap else len(data)
        words = data[lo:hi].split()
        parts.append(np.fromiter(map(names.__getitem__, words), np.int32, len(words)))
        lo = hi
    return (np.concatenate(parts) if parts else np.empty(0, np.int32)), list(names)


def _laid(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, each with symbols of its own and a smaller sentinel behind; and where each begins."""
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(sizes) - sizes
    out, base = np.empty(int(sizes.sum()), np.int64), 0
    for t, at in zip(texts, starts.tolist(), strict=True):
        out[at : at + len(t)] = t + np.int64(base + 1)
        out[at + len(t)] = base
        base += int(t.max()) + 2 if len(t) else 1
    return out, starts


def runs_of(texts: list[np.ndarray], least: int = 24, power: int = 3) -> list[np.ndarray]:
    """For each text its runs as rows (start, length, period), by start and period."""
    if power < 3:
        raise ValueError("power must be 3 or more")
    none = np.empty((0, 3), np.int64)
    out = [none] * len(texts)
    held = [k for k, t in enumerate(texts) if len(t) >= least]
    if not held:
        return out
    t, starts = _laid([texts[k] for k in held])
    n, order = len(t), Suffixes(t)
    roots = []
    for places in (order.isa, n - 1 - order.isa):
        i, j = np.arange(n), next_smaller(places)
        i, j = i[j < n], j[j < n]
        same = t[i] == t[j]
        i, j = i[same], j[same]
        if len(i):
            p, right = j - i, order.common(i, j)
            # The leftmost root of a run lacks less than a period to the left.
            fits = 2 * p + right > np.maximum(least, power * p)
            roots.append(np.stack([i[fits], p[fits], right[fits]], axis=1))
    roots = np.unique(np.concatenate(roots), axis=0) if roots else none
    if not len(roots):
        return out
    which = np.searchsorted(starts, roots[:, 0], side="right") - 1
    some = np.unique(which)
    turned, turned_at = _laid([texts[held[k]][::-1] for k in some])
    back = Suffixes(turned)
    own = np.searchsorted(some, which)
    at = roots[:, 0] - starts[which]
    sizes = np.array([len(texts[held[k]]) for k in some])[own]
    left = np.zeros(len(roots), np.int64)
    inner = np.flatnonzero(at > 0)
    # What stands before i and before i + p, read backwards.
    i = turned_at[own[inner]] + sizes[inner] - at[inner]
    left[inner] = back.common(i, i - roots[inner, 1])
    p = roots[:, 1]
    start, length = at - left, left + p + roots[:, 2]
    true = (left < p) & (length >= np.maximum(least, power * p))
    found = np.unique(np.stack([which, start, p, length], axis=1)[true], axis=0)
    for k in np.unique(found[:, 0]):
        out[held[k]] = found[found[:, 0] == k][:, [1, 3, 2]]
    return out


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: not those that stand in a run behind its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(step)[:n] == 0


def collapse(docs: DataFrame, least: int = 24, power: int = 3) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text, words joined by one space.

    A word is dropped where a run contains it after that run's first period.
    """

    def finish(held: list) -> tuple[list, list, list]:
        counts, runs, texts = [], [], []
        for (words, names), found in zip(held, runs_of([w for w, _ in held], least, power), strict=True):
            counts.append(len(words))
            runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found.tolist()])
            stay = words[_kept(len(words), found)] if len(found) else words
            texts.append(b" ".join(map(names.__getitem__, stay.tolist())).decode("utf-8", "surrogatepass"))
        return counts, runs, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, held, size = 0, [], 0
            for k, text in enumerate(batch.column(1)):
                held.append(word_numbers(text.as_py()))
                size += len(held[-1][0])
                if size >= SLICE or k == batch.num_rows - 1:
                    counts, runs, texts = finish(held)
                    rows = pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(lo, len(held)), pa.array(counts, pa.int64()), rows, pa.array(texts, pa.string())],
                        ["doc_id", "n_words", "runs", "collapsed"],
                    )
                    lo, held, size = k + 1, [], 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return map_batches(docs.select("doc_id", "text"), run, schema)


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the texts made periodic from some word on: h = crc32(doc_id as text), g = floor(h / 10); where
    h % 10 = 0, each word i >= a becomes word a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    A null doc_id has no h and changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10), word_count(F.col("text"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False)) & (n > 0)
    rows = docs.select("doc_id", "text", g.alias("g"), F.when(chosen, F.regexp_extract_all("text", F.lit(f"({WORD})"))).alias("w"))
    a = F.col("g") % F.size("w")
    p = 1 + F.floor((F.size("w") - a) / (3 + F.col("g") % 8))
    rows = rows.select("doc_id", "text", "w", a.alias("a"), p.alias("p"))
    made = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("w").isNotNull(), F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def _stronger(a: Column, b: Column) -> Column:
    """Order of runs by exact exponent, greatest first, then start, then period."""
    by = [b["length"] * a["period"] - a["length"] * b["period"], a["start"] - b["start"], a["period"] - b["period"]]
    return F.coalesce(*(F.nullif(F.signum(x).cast("int"), F.lit(0)) for x in by), F.lit(0))


def op13_periodic_runs(spark, sf_dir):
    """Runs of every document, a tenth made periodic first; per document the strongest run and digests of all runs and of the collapsed text."""
    found = collapse(with_repeats(read(spark, sf_dir, "documents")))
    best = F.get(F.array_sort("runs", _stronger), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    return rows.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
