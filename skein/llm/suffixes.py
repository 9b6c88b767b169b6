"""Suffix arrays, LCP arrays, range minima and next smaller values of integer sequences, by array operations.

A sequence may hold several texts one after the other: each text's symbols are its own (no other text has them), and
each ends with a sentinel smaller than its other symbols, so that no comparison passes a text's end.
"""

from __future__ import annotations

import numpy as np

_BLOCK = 32
_FAR = np.int64(1) << 40


class RangeMin:
    """Minima of stretches of an array: a sparse table over blocks, prefix and suffix minima inside them."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self.values = values
        rows = np.full((-(-max(n, 1) // _BLOCK), _BLOCK), _FAR, np.int64)
        rows.reshape(-1)[:n] = values
        self.before = np.minimum.accumulate(rows, axis=1).reshape(-1)
        self.after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.table = [rows.min(axis=1)]
        while 2 * (half := 1 << (len(self.table) - 1)) <= len(rows):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def query(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima over lo..hi, both included; lo <= hi."""
        a, b = lo // _BLOCK, hi // _BLOCK
        out = np.minimum(self.after[lo], self.before[hi])
        wide = np.flatnonzero(b - a > 1)
        if len(wide):
            first, count = a[wide] + 1, b[wide] - a[wide] - 1
            level = np.frexp(count.astype(np.float64))[1] - 1
            for k in np.unique(level):
                at = wide[level == k]
                x, y = first[level == k], first[level == k] + count[level == k] - (1 << int(k))
                out[at] = np.minimum(out[at], np.minimum(self.table[k][x], self.table[k][y]))
        same = np.flatnonzero(a == b)
        if len(same):
            x, y = lo[same], hi[same]
            least = self.values[x]
            for k in range(1, int((y - x).max()) + 1):
                least = np.minimum(least, self.values[np.minimum(x + k, y)])
            out[same] = least
        return out


class Suffixes:
    """Order (``sa``), places (``isa``) and longest common prefixes (``lcp``, of a suffix and the one before it) of a sequence.

    Prefix doubling: the first round sorts packed symbols, later ones only suffixes not yet told apart. The LCP of two
    neighbours that a round parts is the doubled length plus a range minimum over what earlier rounds have found.
    """

    def __init__(self, t: np.ndarray) -> None:
        n = len(t)
        self.t = t
        bits = max(1, int(t.max()).bit_length()) if n else 1
        h = max(1, min(8, 63 // bits))
        key = np.zeros(n, np.int64)
        for j in range(h):
            key <<= bits
            key[: max(0, n - j)] |= t[j:]
        sa = np.argsort(key)
        key = key[sa]
        parted = np.ones(n, bool)
        parted[1:] = key[1:] != key[:-1]
        lcp = np.full(n, _FAR, np.int64)
        differ = key[1:] ^ key[:-1]
        common = np.zeros(max(0, n - 1), np.int64)
        for j in range(1, h):
            common += (differ >> (bits * (h - j))) == 0
        at = np.flatnonzero(parted[1:])
        lcp[at + 1] = common[at]
        lcp[:1] = 0
        rank = np.empty(n, np.int64)
        rank[sa] = np.maximum.accumulate(np.where(parted, np.arange(n), 0)) if n else 0
        while True:
            alone = parted.copy()
            alone[:-1] &= parted[1:]
            at = np.flatnonzero(~alone)
            if not len(at):
                break
            s = sa[at]
            key = rank[s] * n + rank[s + h]
            order = np.argsort(key)
            key, s = key[order], s[order]
            sa[at] = s
            fresh = np.flatnonzero((key[1:] != key[:-1]) & ~parted[at[1:]]) + 1
            if len(fresh):
                lcp[at[fresh]] = h + RangeMin(lcp).query(key[fresh - 1] % n + 1, key[fresh] % n)
                parted[at[fresh]] = True
            rank[s] = np.maximum.accumulate(np.where(parted[at], at, 0))
            h *= 2
        self.sa, self.isa, self.lcp = sa, rank, lcp
        self._least = RangeMin(lcp)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of the suffixes at i and j, i != j."""
        a, b = self.isa[i], self.isa[j]
        return self._least.query(np.minimum(a, b) + 1, np.maximum(a, b))


def next_smaller(v: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, or the length where there is none; values are distinct.

    All places climb a pyramid of minima together, until a block holds a smaller value, and descend into it.
    """
    n = len(v)
    out = np.full(n, n, np.int64)
    levels = [v]
    while len(levels[-1]) > 1:
        last = levels[-1]
        if len(last) % 2:
            last = np.append(last, np.iinfo(last.dtype).max)
        levels.append(np.minimum(last[::2], last[1::2]))
    who, block = np.arange(n), np.arange(1, n + 1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for least in levels:
        odd = (block & 1 == 1) & (block < len(least))
        hit = np.zeros(len(who), bool)
        hit[odd] = least[block[odd]] < v[who[odd]]
        found.append((who[hit], block[hit]))
        going = ~hit & (block < len(least))
        who, block = who[going], (block[going] + 1) >> 1
    who, block = np.empty(0, np.int64), np.empty(0, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        who, block = np.concatenate([who, found[k][0]]), np.concatenate([block, found[k][1]])
        if k:
            left = levels[k - 1][2 * block] < v[who]
            block = 2 * block + ~left
    out[who] = block
    return out
