"""Toxicity scores by weak supervision.

Voters are lexicon entries (whole words, word beginnings, and either of them only where it comes up densely) and
surface patterns. Lexicon entries come from a short
seed list and from training rows, where entries that nearly only toxic rows hold are found and chosen greedily to
cover the toxic rows several times; choosing ends when no entry covers ``support`` more rows, so that their number
follows from coverage (at most COVERS * toxic rows / support, which is 1,200). A generative label model estimates each voter's accuracy by expectation
maximisation and the voters' conditional correlations, which discount voters that repeat each other. Its posterior
labels train a regularised linear classifier, and the classifier scores every whole text.

Training rows are those labelled rows for which crc32(doc_id as text) mod 3 is not 1, at most about ``max_train`` of
them, chosen by a hash (documented bound; the votes of these rows are what the driver sees). Labels, language, source
and doc_id are never inputs of a score. Several labels of one document count by majority. Null or empty texts get the
classifier's score for a text without any vote. Repeated rows score alike; other columns are ignored. Without any
usable label the seed list alone decides.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import map_batches, read, stored

#: A small seed lexicon.
SEED = ("idiot", "moron", "stupid", "dumb", "loser", "trash", "scum", "worthless", "pathetic", "disgusting", "clown", "imbecile")
MAX_TRAIN = 20_000
THRESHOLD = 0.7
PREFIXES = range(4, 9)
MIN_SUPPORT = 3
MIN_PRECISION = 0.9
#: Dense: at least twice, and so many times in 1000 characters.
DENSE_TIMES, DENSE_RATE = 2, 1.0
#: Log odds that a training row's own label adds to its votes.
LABEL_SAY = 2.0
COVERS = 3
LETTERS = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"(?<=[A-Za-z])[*#@$%]{2,}[A-Za-z]")
DRAWN_OUT = tuple(4 * c for c in "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """The rows kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def is_dense(times: int, length: int) -> bool:
    return times >= DENSE_TIMES and 1000 * times >= DENSE_RATE * length


def entries(text: str) -> set[str]:
    """Lexicon entries that a text holds: words, beginnings of words (a star behind), dense ones (an at sign behind)."""
    words = Counter(LETTERS.findall(text.lower()))
    times: Counter = Counter(words)
    for w, k in words.items():
        for n in PREFIXES:
            if len(w) >= n:
                times[w[:n] + "*"] += k
    found = set(times)
    found.update(e + "@" for e, k in times.items() if k >= DENSE_TIMES and is_dense(k, len(text)))
    return found


class Matcher:
    """Finds lexicon entries in texts: words whole, starred ones at the beginning of a word."""

    def __init__(self, lexicon: list[str]) -> None:
        import ahocorasick

        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        by_stem: dict[str, list[tuple[int, bool]]] = {}
        self.dense = [e.endswith("@") for e in lexicon]
        for k, entry in enumerate(lexicon):
            by_stem.setdefault(entry.rstrip("*@"), []).append((k, "*" not in entry))
        for stem, own in by_stem.items():
            self.automaton.add_word(stem, (len(stem), own))
        if by_stem:
            self.automaton.make_automaton()
        self.empty = not by_stem

    def hits(self, text: str) -> dict[int, int]:
        """Occurrences of each entry that votes."""
        found: dict[int, int] = {}
        if self.empty:
            return found
        lower = text.lower()
        n = len(lower)
        for end, (size, own) in self.automaton.iter(lower):
            start = end + 1 - size
            if start and lower[start - 1].isalpha():
                continue
            follows = end + 1 < n and lower[end + 1].isalpha()
            for k, whole in own:
                if not (whole and follows):
                    found[k] = found.get(k, 0) + 1
        return {k: times for k, times in found.items() if not self.dense[k] or is_dense(times, len(text))}


def patterns(text: str) -> tuple[int, ...]:
    """Surface patterns: shouting, repeated exclamation marks, words with masked letters, drawn-out letters."""
    lower = text.lower()
    shouting = len(text) > 20 and lower != text and text.upper() == text
    return int(shouting), int("!!" in text), int(bool(MASKED.search(text))), int(any(x in lower for x in DRAWN_OUT))


NO_MARKS = patterns("")
PATTERNS = len(NO_MARKS)


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """text and label of the training rows, exact copies once. The labels that are broadcast are bounded by ``max_train``."""
    usable = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
    share = min(1.0, max_train / max(1, usable.count()))
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy(F.xxhash64("text").alias("key")).agg(F.first("text").alias("text"), F.max("label").alias("label"))
    return stored(rows.select("text", "label"), "toxicity-train")


def _counted(rows: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """(entry, n): in how many rows each entry occurs, pre-aggregated in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                found = entries(text.as_py())
                counts.update(found if wanted is None else found & wanted)
        keys = list(counts)
        for lo in range(0, len(keys), 50_000):
            part = keys[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[k] for k in part], pa.int64())], ["entry", "n"])

    return map_batches(rows.select("text"), run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def _votes(rows: DataFrame, lexicon: list[str]) -> DataFrame:
    """label, hits (entry numbers), times, marks (patterns) of each training row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            out = []
            for text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hits = matcher.hits(text)
                out.append((label, list(hits), list(hits.values()), list(patterns(text))))
            if out:
                kinds = [pa.int32(), *[pa.list_(pa.int32())] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["label", "hits", "times", "marks"])

    return map_batches(rows.select("text", "label"), run, "label int, hits array<int>, times array<int>, marks array<int>")


def find_lexicon(rows: DataFrame) -> list[str]:
    """Seed entries and those found in the training rows; all that is collected is bounded by the training bound."""
    toxic = rows.filter("label = 1")
    n_toxic = toxic.count()
    support = max(MIN_SUPPORT, n_toxic // 400)
    common = {r.entry: r.n for r in _counted(toxic, None).filter(F.col("n") >= support).collect()}
    if not common:
        return list(SEED)
    clean = {r.entry: r.n for r in _counted(rows.filter("label = 0"), frozenset(common)).collect()}
    good = [e for e, n in common.items() if n >= MIN_PRECISION * (n + clean.get(e, 0))]
    # Ties in coverage: whole words before beginnings, longer beginnings before shorter.
    good.sort(key=lambda e: (-common[e], "@" in e, "*" in e, -len(e), e))
    holders = [array("i") for _ in good]
    for k, r in enumerate(_votes(toxic, good).select("hits").toLocalIterator()):
        for e in r.hits:
            holders[e].append(k)
    held = [np.frombuffer(h, np.int32) if len(h) else np.empty(0, np.int32) for h in holders]
    covered = np.zeros(n_toxic, np.int32)
    chosen: list[str] = []
    # Gains only fall while rows get covered, so an entry whose gain is still the largest when looked at again is best.
    queue = [(-len(h), e) for e, h in enumerate(held)]
    heapq.heapify(queue)
    while queue:
        old, e = heapq.heappop(queue)
        gain = int((covered[held[e]] < COVERS).sum())
        if gain < support:
            continue
        if gain < -old:
            heapq.heappush(queue, (-gain, e))
            continue
        chosen.append(good[e])
        covered[held[e]] += 1
    return list(dict.fromkeys([*chosen, *SEED]))


@dataclass
class Classifier:
    """A linear model over votes; its size is bounded by the number of voters."""

    lexicon: list[str]
    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(features @ self.weights + self.bias, -30, 30)))


def features(rows: list[tuple[dict[int, int], list[int]]], size: int) -> np.ndarray:
    """Votes as numbers: each entry, any entry, how many entries, how often in all, and the patterns."""
    x = np.zeros((len(rows), size + 3 + PATTERNS))
    for i, (hits, marks) in enumerate(rows):
        for k in hits:
            x[i, k] = 1.0
        if hits:
            x[i, size] = 1.0
            x[i, size + 1] = min(len(hits), 4) / 4
            x[i, size + 2] = np.log1p(min(sum(hits.values()), 50))
        x[i, size + 3 :] = marks
    return x


def label_model(votes: np.ndarray, labels: np.ndarray, steps: int = 20) -> np.ndarray:
    """Posterior toxicity of each row from its votes.

    ``votes``: (rows, voters), 1 for a vote, 0 for none; the last column is the vote "clean". Rates of each voter
    given either label start from the labels and are refined by expectation maximisation, the labels being one more
    voter of fixed trust; a voter's say is divided by one plus its strong correlations with other voters given the label.
    """
    n, m = votes.shape
    prior = (labels.sum() + 1.0) / (n + 2.0)
    q = np.where(labels == 1, 0.95, 0.05)
    say = np.ones(m)
    for step in range(steps):
        on = (votes.T @ q + 0.5) / (q.sum() + 1.0)
        off = (votes.T @ (1 - q) + 0.5) / ((1 - q).sum() + 1.0)
        if step == 2:
            rest = votes - np.outer(q, on) - np.outer(1 - q, off)
            norm = np.sqrt((rest**2).sum(axis=0)) + 1e-9
            corr = np.clip((rest / norm).T @ (rest / norm), 0.0, 1.0)
            np.fill_diagonal(corr, 0.0)
            say = 1.0 / (1.0 + np.where(corr > 0.5, corr, 0.0).sum(axis=1))
        logit = np.log(prior / (1 - prior)) + LABEL_SAY * (2 * labels - 1) + votes @ (say * np.log(on / off))
        q = 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))
    return q


def _fit_linear(x: np.ndarray, q: np.ndarray, ridge: float = 0.05, steps: int = 25) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    penalty = np.full(x1.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (p - q) + penalty * w
        hess = (x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1 + np.diag(penalty)
        move = np.linalg.solve(hess, grad)
        w -= move * min(1.0, 5.0 / (np.abs(move).max() + 1e-9))
        if np.abs(move).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Classifier:
    rows = training_rows(docs, labels, max_train)
    lexicon = find_lexicon(rows)
    found = [(r.label, dict(zip(r.hits, r.times, strict=True)), r.marks) for r in _votes(rows, lexicon).toLocalIterator()]
    # The order in which rows arrive must not matter.
    found.sort(key=lambda r: (r[0], sorted(r[1].items()), r[2]))
    y = np.array([r[0] for r in found], int)
    size = len(lexicon)
    if len(found) == 0 or y.sum() == 0:
        weights = np.zeros(size + 3 + PATTERNS)
        weights[size] = 5.0
        return Classifier(lexicon, weights, -3.0)
    x = features([r[1:] for r in found], size)
    votes = np.hstack([x[:, :size], x[:, size + 3 :], 1.0 - x[:, size : size + 1]])
    return Classifier(lexicon, *_fit_linear(x, label_model(votes, y)))


def score_texts(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits for every row."""
    schema = "doc_id long, score double, n_hits long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.lexicon)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for text in part.column(1).to_pylist():
                    rows.append((matcher.hits(text), patterns(text)) if text else ({}, NO_MARKS))
                scores = model.score(features(rows, len(model.lexicon)))
                n = [sum(r[0].values()) for r in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array(n, pa.int64())], ["doc_id", "score", "n_hits"])

    scored = map_batches(docs.select("doc_id", "text"), run, schema)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_hits"
    )


def drop_toxic(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, columns unchanged; decided row by row, without a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.lexicon)
        for batch in batches:
            keep = []
            at = batch.schema.get_field_index("text")
            for lo in range(0, batch.num_rows, 256):
                texts = batch.column(at).slice(lo, 256).to_pylist()
                rows = [(matcher.hits(t), patterns(t)) if t else ({}, NO_MARKS) for t in texts]
                keep.append(model.score(features(rows, len(model.lexicon))) < threshold)
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return map_batches(docs, run, docs.schema)


def op7_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return score_texts(docs, train(docs, read(spark, sf_dir, "labels")))
