"""Word-shingle sets of whole texts as 64-bit hashes, and their MinHash signatures, by array operations on bytes."""

from __future__ import annotations

import numpy as np

#: Words of a shingle.
SIZE = 5
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_ORDER = mix(np.arange(1, SIZE + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
_BASE = 0x2545F4914F6CDD1D


def _powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(n, np.uint64)
    done, step = 1, base & (2**64 - 1)
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = out[:m] * np.uint64(step)
        step = step * step & (2**64 - 1)
        done *= 2
    return out


_CACHE: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_CACHE.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _CACHE["up"], _CACHE["down"] = _powers(size, _BASE), _powers(size, pow(_BASE, -1, 2**64))
    return _CACHE["up"][:n], _CACHE["down"][:n]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, letters A-Z lower-cased."""
    data = LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    if len(data) == 0:
        return np.empty(0, np.uint64)
    gap = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if len(start) == 0:
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of ``size`` (at most 5) words; of all its words as one where it has fewer."""
    words = word_hashes(text) if text else np.empty(0, np.uint64)
    n = len(words)
    if n == 0:
        return words
    k = min(size, n)
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total += words[j : n - k + 1 + j] * _ORDER[j]
    return np.unique(mix(total + np.uint64(k)))


class MinHash:
    """Signatures of 32-bit minima under ``size`` xor-multiply permutations."""

    def __init__(self, size: int = 128, seed: int = 11) -> None:
        self.size = size
        self.factor = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(2 * seed + 1)) | np.uint64(1)
        self.salt = mix(self.factor)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """Minima of the high halves of hash times factor; for an empty set all ones."""
        out = np.full(self.size, 0xFFFFFFFF, np.uint32)
        for lo in range(0, len(hashes), 2048):
            rows = (hashes[lo : lo + 2048, None] ^ self.salt) * self.factor
            out = np.minimum(out, (rows >> np.uint64(32)).min(axis=0).astype(np.uint32))
        return out


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that together name a set."""
    with np.errstate(over="ignore"):
        a = int(mix(hashes * _ODD).sum(dtype=np.uint64))
        b = int(np.bitwise_xor.reduce(mix(hashes + _ODD))) if len(hashes) else 0
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return signed(a), signed(b)
