"""A plain VP8L writer with every feature, to test the decoder: Huffman codes, runs, groups, references, cache, transforms."""

import heapq
import struct

import numpy as np

from skein.llm.webp import CACHE_FACTOR, LENGTH_ORDER, NEAR


class Out:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> k) & 1 for k in range(n)]

    def bytes(self):
        return np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()


def lengths_of(counts, limit=15):
    used = [s for s, c in enumerate(counts) if c]
    if len(used) < 2:
        return {s: 1 for s in used}
    heap = [(max(counts[s], sum(counts) >> (limit - 2)), s, (s,)) for s in used]
    heapq.heapify(heap)
    out = dict.fromkeys(used, 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            out[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    return out


def codes_of(lengths):
    out, code, last = {}, 0, 0
    for s in sorted(lengths, key=lambda s: (lengths[s], s)):
        code <<= lengths[s] - last
        last = lengths[s]
        out[s] = (int(format(code, f"0{last}b")[::-1], 2), last)
        code += 1
    return {s: (0, 0) for s in out} if len(out) == 1 else out


def put_code(out, size, counts):
    lengths = lengths_of(counts)
    if len(lengths) <= 2 and all(s < 256 for s in lengths):
        used = sorted(lengths) or [0]
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        small = used[0] < 2
        out.put(0 if small else 1, 1)
        out.put(used[0], 1 if small else 8)
        if len(used) == 2:
            out.put(used[1], 8)
        return codes_of(lengths or {0: 1})
    seq, at, full = [], 0, [lengths.get(s, 0) for s in range(size)]
    while full and not full[-1]:
        full.pop()
    last = 8
    while at < len(full):
        run = next((k for k in range(at, len(full)) if full[k] != full[at]), len(full)) - at
        if full[at] == 0 and run >= 3:
            run = min(run, 138)
            seq.append((18, run - 11, 7) if run >= 11 else (17, run - 3, 3))
            at += run
        elif full[at] and full[at] == last and run >= 3:
            run = min(run, 6)
            seq.append((16, run - 3, 2))
            at += run
        else:
            seq.append((full[at], 0, 0))
            last = full[at] or last
            at += 1
    counted = [0] * 19
    for s, _, _ in seq:
        counted[s] += 1
    inner = lengths_of(counted, 7)
    out.put(0, 1)
    n = max(4, max(LENGTH_ORDER.index(s) for s in inner) + 1)
    out.put(n - 4, 4)
    for s in LENGTH_ORDER[:n]:
        out.put(inner.get(s, 0), 3)
    out.put(1, 1)
    out.put(7, 3)
    out.put(len(seq) - 2, 16)
    inner = codes_of(inner)
    for s, extra, width in seq:
        out.put(*inner[s])
        out.put(extra, width)
    return codes_of(lengths)


def prefix(value):
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    n = v.bit_length() - 1
    second = (v >> (n - 1)) & 1
    return 2 * n + second, n - 1, v & ((1 << (n - 1)) - 1)


def tokens(argb, width, cache_bits, refs):
    seen, cache, out, at = {}, [0] * (1 << cache_bits), [], 0
    near = {dx + dy * width: k + 1 for k, (dx, dy) in reversed(list(enumerate(NEAR))) if dx + dy * width > 0}

    def put(k):
        if cache_bits:
            cache[(CACHE_FACTOR * argb[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = argb[k]
        seen[tuple(argb[k : k + 3])] = k

    while at < len(argb):
        back = seen.get(tuple(argb[at : at + 3])) if refs else None
        if back is not None and len(argb) - at >= 3:
            n = 3
            while at + n < len(argb) and n < 4096 and argb[back + n] == argb[at + n]:
                n += 1
            out.append(("ref", at, n, near.get(at - back, at - back + 120)))
            for k in range(at, at + n):
                put(k)
            at += n
            continue
        key = (CACHE_FACTOR * argb[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        out.append(("cache", at, key) if cache_bits and cache[key] == argb[at] and at else ("pixel", at, argb[at]))
        put(at)
        at += 1
    return out


def put_image(out, argb, width, top, cache_bits=0, refs=False, group_bits=0):
    argb = [int(x) for x in argb]
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    height = len(argb) // width
    group = lambda k: 0
    groups = 1
    if top:
        out.put(1 if group_bits else 0, 1)
        if group_bits:
            out.put(group_bits - 2, 3)
            across, down = -(-width >> group_bits), -(-height >> group_bits)
            across, down = (width + (1 << group_bits) - 1) >> group_bits, (height + (1 << group_bits) - 1) >> group_bits
            put_image(out, [(k % 3) << 8 for k in range(across * down)], across, False)
            groups = min(3, across * down)
            group = lambda k: ((k // width >> group_bits) * across + (k % width >> group_bits)) % 3
    toks = tokens(argb, width, cache_bits, refs)
    size = 280 + (1 << cache_bits if cache_bits else 0)
    counts = [[[0] * size, [0] * 256, [0] * 256, [0] * 256, [0] * 40] for _ in range(groups)]
    for t in toks:
        c = counts[group(t[1])]
        if t[0] == "pixel":
            for ch, shift in enumerate((8, 16, 0, 24)):
                c[ch][t[2] >> shift & 255] += 1
        elif t[0] == "ref":
            c[0][256 + prefix(t[2])[0]] += 1
            c[4][prefix(t[3])[0]] += 1
        else:
            c[0][280 + t[2]] += 1
    codes = [[put_code(out, len(x), x) for x in c] for c in counts]
    for t in toks:
        c = codes[group(t[1])]
        if t[0] == "pixel":
            for ch, shift in enumerate((8, 16, 0, 24)):
                out.put(*c[ch][t[2] >> shift & 255])
        elif t[0] == "ref":
            for value, base, ch in ((t[2], 256, 0), (t[3], 0, 4)):
                s, n, extra = prefix(value)
                out.put(*c[ch][base + s])
                out.put(extra, n)
        else:
            out.put(*c[0][280 + t[2]])


def container(bits):
    body = bits.bytes()
    padded = body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + padded


def start(width, height):
    out = Out()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    return out
