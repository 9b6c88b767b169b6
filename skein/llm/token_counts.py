"""Token counts by dynamic programming over a trie of pre-tokens.

A text becomes pre-tokens: white-space marked words, each with the marks before it. Distinct pre-tokens go into a
trie; every trie node keeps the best unigram score of its prefix and the number of tokens on that best path, so the
forward step is made once per shared prefix and a pre-token's count is read at its terminal node. Characters outside
the vocabulary count as their UTF-8 bytes where the model has byte pieces, else as one unknown token, at a score ten
below the least. Scores are those stored in a unigram model file; for a BPE file a unigram model is derived from its
pieces' ranks (``piece_model.as_unigram``), no tokenizer being trained here. Equal scores go to the longer last piece.

A task's trie is kept from batch to batch and started afresh beyond ``max_nodes`` nodes, also inside a text. Pre-tokens
of more than ``LONG`` characters, which hardly share prefixes, don't enter it: their forward scores are kept only as far back
as the longest piece reaches. Both bound memory, not results. Counts sum whole texts. Null and empty texts have 0 tokens. Repeated rows count each; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm import piece_model as pm
from skein.llm.common import map_batches, read

PRETOKEN = re.compile(f"{pm.MARK}*[^{pm.MARK}]+|{pm.MARK}+")
#: Fixed value of the format: how far below the least score an unknown character lies.
UNKNOWN_PENALTY = 10.0
#: Longer pre-tokens are scored outside the trie; words that are counted between two looks at its size.
LONG, STRIDE = 1000, 4096


class _Counts(dict):
    """Token counts of pre-tokens at their terminal nodes; a new one is inserted into the trie on first sight."""

    def __init__(self, insert, passing) -> None:
        super().__init__()
        self.insert, self.passing = insert, passing

    def __missing__(self, pretoken: str) -> int:
        if len(pretoken) > LONG:
            return self.passing(pretoken)
        found = self[pretoken] = self.insert(pretoken)
        return found


class ForwardTrie:
    """Best scores and token counts of prefixes."""

    def __init__(self, model: pm.PieceModel, max_nodes: int = 2_000_000) -> None:
        self.max_nodes = max_nodes
        self.scores = {p: s for p, s, kind in model.pieces if kind in (pm.NORMAL, pm.USER_DEFINED)}
        if any(pm.MARK in p.lstrip(pm.MARK) for p in self.scores):
            raise ValueError("a piece crosses word boundaries: pre-tokens can't be scored on their own")
        self.longest = max(map(len, self.scores), default=1)
        self.unknown = model.min_score - UNKNOWN_PENALTY
        self.bytes = model.byte_fallback
        self.pieces = ahocorasick.Automaton()
        for p, s in self.scores.items():
            self.pieces.add_word(p, (len(p), s))
        self.pieces.make_automaton()
        self.reset()

    def reset(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best = [0.0]
        self.count = [0]
        self.done = _Counts(self._insert, self._passing)

    def tokens(self, pretokens: list[str]) -> int:
        """Tokens of some pre-tokens on their best paths; prefixes' scores are shared."""
        total = 0
        for lo in range(0, len(pretokens), STRIDE):
            total += sum(map(self.done.__getitem__, pretokens[lo : lo + STRIDE]))
            if len(self.best) > self.max_nodes:
                self.reset()
        return total

    def _passing(self, word: str) -> int:
        """The count of a long pre-token, with the scores of the last ``longest`` prefixes only."""
        size = self.longest + 1
        best, count = [0.0] * size, [0] * size
        ends = self.pieces.iter(word)
        end, piece = next(ends, (len(word), None))
        for d, c in enumerate(word):
            top, n, here = None, 0, d % size
            if c not in self.scores:
                top = best[here] + self.unknown
                n = count[here] + (len(c.encode("utf-8", "surrogatepass")) if self.bytes else 1)
            while end == d:
                start = (d + 1 - piece[0]) % size
                score = piece[1] + best[start]
                if top is None or score > top:
                    top, n = score, count[start] + 1
                end, piece = next(ends, (len(word), None))
            best[(d + 1) % size], count[(d + 1) % size] = top, n
        return count[len(word) % size]

    def _insert(self, word: str) -> int:
        child, best, count, scores = self.child, self.best, self.count, self.scores
        path, node, known = [0], 0, 0
        for c in word:
            nxt = child.get((node, c))
            if nxt is None:
                break
            node = nxt
            path.append(node)
            known += 1
        if known == len(word):
            return count[node]
        # Pieces by the place where they end; those that end inside the shared prefix are in its scores already.
        ends: list[list[tuple[int, float]]] = [[] for _ in range(len(word) - known)]
        for end, (size, score) in self.pieces.iter(word, max(0, known - self.longest)):
            if end >= known:
                ends[end - known].append((size, score))
        for d in range(known, len(word)):
            c = word[d]
            top, n = None, 0
            if c not in scores:
                top = best[node] + self.unknown
                n = count[node] + (len(c.encode("utf-8", "surrogatepass")) if self.bytes else 1)
            for size, score in ends[d - known]:
                start = path[d + 1 - size]
                score += best[start]
                if top is None or score > top:
                    top, n = score, count[start] + 1
            child[(node, c)] = nxt = len(best)
            node = nxt
            best.append(top)
            count.append(n)
            path.append(node)
        return count[node]


def normalise(text: str, model: pm.PieceModel) -> str:
    """White space as the model wants it: marked, with the leading mark."""
    if model.remove_extra_whitespaces:
        text = re.sub(" +", " ", text.strip(" "))
    if text and model.add_dummy_prefix:
        text = " " + text
    return text.replace(" ", pm.MARK)


def count_tokens(docs: DataFrame, model_path: str = pm.MODEL_PATH, max_nodes: int = 2_000_000) -> DataFrame:
    """doc_id, n_pretokens, n_tokens. The model is read once on the driver (its size is fixed)."""
    model = pm.as_unigram(pm.load(model_path)[1])
    if model.charsmap:
        raise ValueError("models with a character map need the encoder, not the counter")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ForwardTrie(model, max_nodes)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                words, tokens = [], []
                for text in part.column(1).to_pylist():
                    found = PRETOKEN.findall(normalise(text, model)) if text else []
                    words.append(len(found))
                    tokens.append(trie.tokens(found))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"]
                )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_pretokens long, n_tokens long")


def op2_token_counts(spark, sf_dir):
    return count_tokens(read(spark, sf_dir, "documents"))
