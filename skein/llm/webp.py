"""Lossless WebP (VP8L) pixels: a full decoder, and a writer for payload bytes.

The decoder reads the RIFF container, prefix codes (simple, normal and their run-length coded lengths), prefix groups,
back-references and the colour cache, and inverts the predictor, cross-colour, subtract-green and palette transforms.
Streams of one prefix group without references or cache are read with array operations: every bit is looked up as if a pixel
began there, and the chain of pixels is followed through what was found. Codes of one length need no chain. Streams with references or a
cache are read symbol by symbol.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

#: Fixed values of the format.
SIGNATURE = 0x2F
MAX_SIDE = 1 << 14
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class Bits:
    """Least significant bit first."""

    def __init__(self, data: bytes) -> None:
        self.data = data + bytes(8)
        self.at = 0

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 6], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")
        return value


    def same(self, at: int, n: int) -> bool:
        """Whether the next n bits are those at ``at``."""

        def cut(at: int) -> int:
            return (int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)

        return cut(at) == cut(self.at)

    def array(self, n: int) -> np.ndarray:
        """The next n bits as 0 and 1."""
        byte, skip = divmod(self.at, 8)
        raw = np.frombuffer(self.data, np.uint8, min((skip + n + 7) >> 3, len(self.data) - byte), byte)
        found = np.unpackbits(raw, bitorder="little")[skip : skip + n]
        if len(found) < n:
            raise ValueError("the stream ends early")
        self.at += n
        return found


class Prefix:
    """A canonical prefix code from its lengths: a table over the next bits."""

    def __init__(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths)
        if len(used) == 0:
            used = np.array([0])
        self.symbols = used
        own = lengths[used].astype(np.int64)
        self.single = int(used[0]) if len(used) == 1 else None
        self.bits = 0 if len(used) == 1 else int(own.max())
        #: The common length where all codes have the same, else None.
        self.uniform = 0 if len(used) == 1 else (self.bits if own.min() == self.bits and len(used) == 1 << self.bits else None)
        self._array: np.ndarray | None = None
        self._table: list[int] | None = None
        self._own = own
        #: Whether its description ended by its own count of lengths, for literals only: then it reads the same for any channel.
        self.counted = False

    @property
    def array(self) -> np.ndarray:
        """For the next ``bits`` bits: the symbol times 16, and its code's length."""
        if self._array is None:
            table = np.full(1 << self.bits, -1, np.int64)
            code, last = 0, 0
            for n, k in sorted(zip(self._own.tolist(), range(len(self._own)), strict=True)):
                code <<= n - last
                last = n
                table[int(format(code, f"0{n}b")[::-1], 2) :: 1 << n] = int(self.symbols[k]) << 4 | n
                code += 1
            if code != 1 << last or (table < 0).any():
                raise ValueError("a prefix code is not complete")
            self._array = table
        return self._array

    @property
    def table(self) -> list[int]:
        if self._table is None:
            self._table = self.array.tolist()
        return self._table

    def next(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        found = self.table[bits.peek(self.bits)]
        bits.at += found & 15
        return found >> 4


def _read_prefix(bits: Bits, size: int) -> Prefix:
    lengths = np.zeros(max(size, 256), np.uint8)
    if bits.read(1):
        both = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if both:
            lengths[bits.read(8)] = 1
        return Prefix(lengths)
    of_lengths = np.zeros(19, np.uint8)
    for k in range(4 + bits.read(4)):
        of_lengths[LENGTH_ORDER[k]] = bits.read(3)
    code = Prefix(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    counted = left < size
    at, last = 0, 8
    if code.uniform == 1 and code.symbols[1] < 16:  # one bit for each length and no runs: read at once
        at = min(size, left)
        lengths[:at] = code.symbols[bits.array(at)]
        left = 0
    while at < size and left > 0:
        left -= 1
        n = code.next(bits)
        if n < 16:
            lengths[at] = n
            at += 1
            last = n or last
        else:
            times = 3 + bits.read(2) if n == 16 else 3 + bits.read(3) if n == 17 else 11 + bits.read(7)
            if at + times > size:
                raise ValueError("code lengths run over")
            if n == 16:
                lengths[at : at + times] = last
            at += times
    made = Prefix(lengths)
    made.counted = counted and left == 0 and at <= 256
    return made


def _read_prefixes(bits: Bits, sizes: tuple[int, ...]) -> list[Prefix]:
    """The codes of a prefix group; a description that is repeated bit by bit isn't worked out again."""
    out: list[Prefix] = []
    last = None
    for size in sizes:
        begin = bits.at
        if last is not None and bits.same(*last):
            out.append(out[-1])
            bits.at += last[1]
            continue
        out.append(_read_prefix(bits, size))
        last = (begin, bits.at - begin) if out[-1].counted else None
    return out


def _reach(bits: Bits, symbol: int) -> int:
    """Value of a length or distance prefix symbol."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _uniform_pixels(bits: Bits, codes: list[Prefix], n: int) -> np.ndarray:
    """Pixels of a stream in which every channel's codes have one length."""
    widths = [c.uniform for c in codes]
    step = sum(widths)
    out = np.zeros(n, np.uint32)
    if step == 0:
        for c, shift in zip(codes, (8, 16, 0, 24), strict=True):
            out |= np.uint32(c.single << shift)
        return out
    raw = np.frombuffer(bits.data, np.uint8)
    for lo in range(0, n, 1 << 19):
        m = min(n - lo, 1 << 19)
        first = bits.at + lo * step
        flat = np.unpackbits(raw[first >> 3 : ((first + m * step + 7) >> 3)], bitorder="little")
        cells = flat[first & 7 : (first & 7) + m * step]
        if len(cells) < m * step:
            raise ValueError("the stream ends early")
        cells = cells.reshape(m, step)
        at = 0
        for c, width, shift in zip(codes, widths, (8, 16, 0, 24), strict=True):
            if width == 0:
                value = np.uint32(c.single)
            else:
                value = c.symbols.astype(np.uint32)[np.packbits(cells[:, at : at + width], axis=1)[:, 0] >> (8 - width)]
            out[lo : lo + m] |= value << np.uint32(shift)
            at += width
    bits.at += n * step
    return out


#: Bits that are looked up at once; no pixel of four codes is longer than FURTHEST bits.
_AHEAD, FURTHEST = 1 << 17, 64


def _coded_pixels(bits: Bits, codes: list[Prefix], n: int) -> np.ndarray:
    """Pixels of a stream of literals with any prefix codes, in stretches of bits."""
    out = np.zeros(n, np.uint32)
    tables = [None if c.single is not None else c.array for c in codes]
    raw = np.frombuffer(bits.data, np.uint8)
    have, done, shifts = 8 * (len(bits.data) - 8), 0, np.arange(8)
    while done < n:
        byte, skip = divmod(bits.at, 8)
        part = raw[byte : byte + ((_AHEAD + FURTHEST) >> 3)]
        end = min(_AHEAD, 8 * len(part))
        part = np.concatenate([part, np.zeros(2 + FURTHEST // 8, np.uint8)]).astype(np.int64)
        words = part[:-2] | part[1:-1] << 8 | part[2:] << 16
        window = ((words[:, None] >> shifts) & 0x7FFF).reshape(-1)
        place = np.arange(len(window) - FURTHEST)
        found = []
        for table in tables:
            if table is not None:
                hit = table.take(window.take(place) & (len(table) - 1))
                found.append(hit)
                place = place + (hit & 15)
        after, starts, at = memoryview(place), [], skip
        keep = starts.append
        while at < end:
            keep(at)
            at = after[at]
        m = min(len(starts), n - done)
        at = starts[m] if m < len(starts) else at
        at_pixel = np.array(starts[:m], np.int64)
        column = iter(found)
        for c, table, shift in zip(codes, tables, (8, 16, 0, 24), strict=True):
            value = np.uint32(c.single) if table is None else (next(column).take(at_pixel) >> 4).astype(np.uint32)
            out[done : done + m] |= value << np.uint32(shift)
        done += m
        bits.at += at - skip
        if bits.at > have or not m:
            raise ValueError("the stream ends early")
    return out


def _image(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """An entropy-coded image as a row of ARGB values."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    group_bits, groups_of, count = 0, None, 1
    if top and bits.read(1):
        group_bits = bits.read(3) + 2
        across, down = (width + (1 << group_bits) - 1) >> group_bits, (height + (1 << group_bits) - 1) >> group_bits
        groups_of = ((_image(bits, across, down, False) >> 8) & 0xFFFF).astype(np.int64)
        count = int(groups_of.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [_read_prefixes(bits, sizes) for _ in range(count)]
    n = width * height
    if count == 1 and not cache_bits and groups[0][0].symbols[-1] < 256:
        uniform = all(c.uniform is not None for c in groups[0][:4])
        return (_uniform_pixels if uniform else _coded_pixels)(bits, groups[0][:4], n)
    out = [0] * n
    cache = [0] * (1 << cache_bits) if cache_bits else None
    shift = 32 - cache_bits
    at = cached = 0
    green, red, blue, alpha, far = groups[0]
    while at < n:
        if groups_of is not None:
            y, x = divmod(at, width)
            green, red, blue, alpha, far = groups[groups_of[(y >> group_bits) * across + (x >> group_bits)]]
        symbol = green.next(bits)
        if symbol < 256:
            r = red.next(bits)
            b = blue.next(bits)
            out[at] = alpha.next(bits) << 24 | r << 16 | symbol << 8 | b
            at += 1
        elif symbol < 280:
            length = _reach(bits, symbol - 256)
            code = _reach(bits, far.next(bits))
            if code > 120:
                back = code - 120
            else:
                dx, dy = NEAR[code - 1]
                back = max(1, dx + dy * width)
            if back > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            for k in range(at, at + length):
                out[k] = out[k - back]
            at += length
        else:
            while cached < at:
                cache[(CACHE_FACTOR * out[cached] & 0xFFFFFFFF) >> shift] = out[cached]
                cached += 1
            out[at] = cache[symbol - 280]
            at += 1
    if bits.at > 8 * (len(bits.data) - 8):
        raise ValueError("the stream ends early")
    return np.array(out, np.uint32)


def _channels(argb: np.ndarray) -> np.ndarray:
    """(n, 4) int: alpha, red, green, blue."""
    return np.stack([(argb >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def _packed(channels: np.ndarray) -> np.ndarray:
    c = (channels & 255).astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def _predict(mode: int, left: list, up: list, right_up: list, left_up: list) -> list:
    """The predicted pixel of a mode above 4."""
    if mode == 5:
        return [(((a + d) >> 1) + b) >> 1 for a, b, d in zip(left, up, right_up, strict=True)]
    if mode == 6:
        return [(a + b) >> 1 for a, b in zip(left, left_up, strict=True)]
    if mode == 7:
        return [(a + b) >> 1 for a, b in zip(left, up, strict=True)]
    if mode == 8:
        return [(a + b) >> 1 for a, b in zip(left_up, up, strict=True)]
    if mode == 9:
        return [(a + b) >> 1 for a, b in zip(up, right_up, strict=True)]
    if mode == 10:
        return [(((a + c) >> 1) + ((b + d) >> 1)) >> 1 for a, b, c, d in zip(left, up, left_up, right_up, strict=True)]
    if mode == 11:
        to_left = sum(abs(b - c) for b, c in zip(up, left_up, strict=True))
        to_up = sum(abs(a - c) for a, c in zip(left, left_up, strict=True))
        return left if to_left < to_up else up
    if mode == 12:
        return [_clamp(a + b - c) for a, b, c in zip(left, up, left_up, strict=True)]
    if mode == 13:
        out = []
        for a, b, c in zip(left, up, left_up, strict=True):
            mean = (a + b) >> 1
            half = mean - c
            out.append(_clamp(mean + (half >> 1 if half >= 0 else -(-half >> 1))))
        return out
    return [255, 0, 0, 0]


def _undo_predictor(argb: np.ndarray, width: int, height: int, bits: int, modes: np.ndarray) -> np.ndarray:
    across = (width + (1 << bits) - 1) >> bits
    modes = ((modes >> 8) & 15).reshape(-1, across)
    rest = _channels(argb).reshape(height, width, 4)
    out = np.zeros_like(rest)
    out[0, 0] = rest[0, 0] + [255, 0, 0, 0]
    out[0] = np.cumsum(np.concatenate([out[0, :1], rest[0, 1:]]), axis=0) & 255
    for y in range(1, height):
        row_modes = np.repeat(modes[y >> bits], 1 << bits)[:width].copy()
        row_modes[0] = 2
        above = out[y - 1]
        if (row_modes[1:] == 1).all():
            first = (rest[y, :1] + above[:1]) & 255
            out[y] = np.cumsum(np.concatenate([first, rest[y, 1:]]), axis=0) & 255
            continue
        if np.isin(row_modes, (0, 2, 4)).all():
            base = np.where((row_modes == 2)[:, None], above, np.array([255, 0, 0, 0]))
            base[1:] = np.where((row_modes == 4)[1:, None], above[:-1], base[1:])
            out[y] = (rest[y] + base) & 255
            continue
        up_row, line, mode_list = above.tolist(), rest[y].tolist(), row_modes.tolist()
        done: list[list[int]] = []
        for x in range(width):
            mode = mode_list[x]
            if mode == 2:
                base = up_row[x]
            elif mode == 1:
                base = done[x - 1]
            else:
                right_up = up_row[x + 1] if x + 1 < width else done[0]
                if mode == 3:
                    base = right_up
                elif mode == 4:
                    base = up_row[x - 1]
                else:
                    base = _predict(mode, done[x - 1], up_row[x], right_up, up_row[x - 1])
            done.append([(a + b) & 255 for a, b in zip(line[x], base, strict=True)])
        out[y] = done
    return _packed(out.reshape(-1, 4))


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def _undo_cross_colour(argb: np.ndarray, width: int, height: int, bits: int, multipliers: np.ndarray) -> np.ndarray:
    across = (width + (1 << bits) - 1) >> bits
    y, x = np.divmod(np.arange(width * height), width)
    m = _channels(multipliers)[(y >> bits) * across + (x >> bits)]
    c = _channels(argb)
    green = _signed(c[:, 2])
    c[:, 1] = (c[:, 1] + (_signed(m[:, 3]) * green >> 5)) & 255
    c[:, 3] += (_signed(m[:, 2]) * green >> 5) + (_signed(m[:, 1]) * _signed(c[:, 1]) >> 5)
    return _packed(c)


def _undo_palette(argb: np.ndarray, width: int, height: int, bits: int, palette: np.ndarray) -> np.ndarray:
    index = (argb >> np.uint32(8)) & np.uint32(255)
    if bits:
        each, per = 8 >> bits, 1 << bits
        parts = np.stack([(index >> np.uint32(k * each)) & np.uint32((1 << each) - 1) for k in range(per)], axis=-1)
        index = parts.reshape(height, -1)[:, :width].reshape(-1)
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index]


def decode(data: bytes) -> np.ndarray:
    """Pixels of one lossless WebP file: uint8 array of shape (height, width, 4), red, green, blue, alpha."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at, end = 12, min(len(data), 8 + struct.unpack("<I", data[4:8])[0])
    while at + 8 <= end and data[at : at + 4] != b"VP8L":
        size = struct.unpack("<I", data[at + 4 : at + 8])[0]
        at += 8 + size + (size & 1)
    if at + 8 > end:
        raise ValueError("no lossless image")
    size = struct.unpack("<I", data[at + 4 : at + 8])[0]
    bits = Bits(data[at + 8 : at + 8 + size])
    if bits.read(8) != SIGNATURE:
        raise ValueError("wrong signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, inner = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (0, 1):
            block = bits.read(3) + 2
            side = lambda n, b=block: (n + (1 << b) - 1) >> b
            extra = _image(bits, side(inner), side(height), False)
            undo.append((_undo_predictor if kind == 0 else _undo_cross_colour, inner, block, extra))
        elif kind == 3:
            n = bits.read(8) + 1
            steps = _channels(_image(bits, n, 1, False))
            palette = _packed(np.cumsum(steps, axis=0))
            block = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((_undo_palette, inner, block, palette))
            inner = (inner + (1 << block) - 1) >> block
        else:
            undo.append((None, inner, 0, None))
    argb = _image(bits, inner, height, True)
    for step, across, block, extra in reversed(undo):
        if step is None:
            c = _channels(argb)
            c[:, 1] += c[:, 2]
            c[:, 3] += c[:, 2]
            argb = _packed(c)
        else:
            argb = step(argb, across, height, block, extra)
    c = argb.astype("<u4").view(np.uint8).reshape(height, width, 4)
    return c[..., [2, 1, 0, 3]]


# Writing: prefix codes by frequency, or of one length where their description costs more than they save; over a palette where few
# colours repeat.

#: Longest codes that the writer makes, of symbols and of code lengths.
LONGEST, LONGEST_LENGTH = 11, 7


def code_lengths(counts: dict[int, int], limit: int) -> dict[int, int]:
    """Lengths of an optimal prefix code of two symbols or more; counts are levelled until no code is over the limit."""
    while True:
        heap = [(c, s, (s,)) for s, c in counts.items()]
        heapq.heapify(heap)
        length = dict.fromkeys(counts, 0)
        while len(heap) > 1:
            a, x, low = heapq.heappop(heap)
            b, _, high = heap[0]
            for s in low:
                length[s] += 1
            for s in high:
                length[s] += 1
            heapq.heapreplace(heap, (a + b, x, low + high))
        if max(length.values()) <= limit:
            return length
        counts = {s: (c + 1) // 2 for s, c in counts.items()}


def canonical(length: dict[int, int]) -> dict[int, int]:
    """The codes of some lengths as the stream has them: first bit lowest."""
    out, code, last = {}, 0, 0
    for s in sorted(length, key=lambda s: (length[s], s)):
        code <<= length[s] - last
        last = length[s]
        out[s] = int(format(code, f"0{last}b")[::-1], 2)
        code += 1
    return out


def _described(length: dict[int, int]) -> np.ndarray:
    """A code's description: its lengths up to the last used symbol, runs of zeros shortened, with their count."""
    steps: list[tuple[int, int, int]] = []  # symbol, extra bits' value and width
    at = 0
    for s in sorted(length):
        gap = s - at
        while gap > 0:
            if gap >= 11:
                run = min(gap, 138)
                steps.append((18, run - 11, 7))
            elif gap >= 3:
                run = gap
                steps.append((17, run - 3, 3))
            else:
                run = 1
                steps.append((0, 0, 0))
            gap -= run
        steps.append((length[s], 0, 0))
        at = s + 1
    counts: dict[int, int] = {}
    for s, _, _ in steps:
        counts[s] = counts.get(s, 0) + 1
    if len(counts) == 1:
        counts[0 if 0 not in counts else 1] = 1
    of = code_lengths(counts, LONGEST_LENGTH)
    code = canonical(of)
    value = at = 0
    last = max(LENGTH_ORDER.index(s) for s in of)
    number = max(4, last + 1)
    for v, w in [(0, 1), (number - 4, 4), *((of.get(s, 0), 3) for s in LENGTH_ORDER[:number]), (1, 1), (3, 3), (len(steps) - 2, 8)]:
        value |= v << at
        at += w
    for s, extra, w in steps:
        value |= (code[s] | extra << of[s]) << at
        at += of[s] + w
    return np.unpackbits(np.frombuffer(value.to_bytes((at + 7) >> 3, "little"), np.uint8), bitorder="little")[:at]


def _coded_image(green: np.ndarray, red: np.ndarray, blue: np.ndarray) -> list[np.ndarray] | None:
    """Codes and pixels of an opaque image, one code by frequency for its three channels; none where codes of one length are shorter."""
    flat = np.stack([green, red, blue], axis=1).reshape(-1)
    times = np.bincount(flat, minlength=256)
    used = np.flatnonzero(times)
    if len(used) < 3:
        return None
    length = code_lengths({int(s): int(times[s]) for s in used}, LONGEST)
    code, size = np.zeros(256, np.int32), np.zeros(256, np.int64)
    for s, c in canonical(length).items():
        code[s], size[s] = c, length[s]
    total = int((size * times).sum())
    head = _described(length)
    plain = sum(int(len(np.unique(v)) - 1).bit_length() * len(v) + 310 for v in (green, red, blue))
    if total + 3 * len(head) >= plain:
        return None
    own = size[flat]
    ends = np.cumsum(own)
    spot = np.arange(total, dtype=np.int64) - np.repeat(ends - own, own)
    pixels = (np.repeat(code[flat], own) >> spot.astype(np.int32)).astype(np.uint8) & 1
    opaque = _number_bits((1, 1), (0, 1), (1, 1), (255, 8))
    far = _number_bits((1, 1), (0, 1), (0, 1), (0, 1))
    return [head, head, head, opaque, far, pixels]



def _number_bits(*pairs: tuple[int, int]) -> np.ndarray:
    """Bits of (value, width) pairs, least significant first."""
    return np.concatenate([np.array([(v >> k) & 1 for k in range(w)], np.uint8) for v, w in pairs])


def _uniform_code(values: np.ndarray, size: int) -> tuple[np.ndarray, int, np.ndarray]:
    """A complete code of one length over the values that occur: its description, its length, code by value."""
    used = np.flatnonzero(np.bincount(values, minlength=256))
    width = int(len(used) - 1).bit_length()
    code = np.zeros(256, np.uint8)
    if len(used) <= 2:
        code[used] = np.arange(len(used))
        head = [(1, 1), (len(used) - 1, 1), (1, 1), (int(used[0]), 8)]
        return _number_bits(*head, *([(int(used[1]), 8)] if len(used) == 2 else [])), width, code
    spare = np.setdiff1d(np.arange(256), used, assume_unique=True)[: (1 << width) - len(used)]
    used = np.sort(np.concatenate([used, spare]))
    code[used] = np.arange(len(used))
    # Code lengths are 0 or `width`: a one-bit code for either, given in the format's order of lengths.
    last = max(LENGTH_ORDER.index(0), LENGTH_ORDER.index(width))
    head = [(0, 1), (max(0, last + 1 - 4), 4)] + [(int(s in (0, width)), 3) for s in LENGTH_ORDER[: last + 1]] + [(0, 1)]
    lengths = np.zeros(size, np.uint8)
    lengths[used] = 1
    if len(used) == size:
        return _number_bits(*head[:2], *[(int(s == width), 3) for s in LENGTH_ORDER[: last + 1]], (0, 1)), width, code
    return np.concatenate([_number_bits(*head), lengths]), width, code


def _uniform_image(channels: list[np.ndarray]) -> list[np.ndarray]:
    """Codes and pixels of an image from green, red, blue and alpha values."""
    codes = [_uniform_code(v, s) for v, s in zip(channels, (280, 256, 256, 256), strict=True)]
    cells = []
    for v, (_, width, code) in zip(channels, codes, strict=True):
        if width:
            cells.append(np.unpackbits(code[v][:, None] << np.uint8(8 - width), axis=1, count=width))
    far = _number_bits((1, 1), (0, 1), (0, 1), (0, 1))
    pixels = np.concatenate(cells, axis=1).reshape(-1) if cells else np.empty(0, np.uint8)
    return [*(head for head, _, _ in codes), far, pixels]


def encode_rgb(rgb: np.ndarray) -> bytes:
    """A lossless WebP file of an (height, width, 3) uint8 array."""
    height, width, _ = rgb.shape
    if not (0 < height <= MAX_SIDE and 0 < width <= MAX_SIDE):
        raise ValueError("an image's sides are from 1 to 16384")
    flat = rgb.reshape(-1, 3)
    parts = [_number_bits((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3))]
    opaque = np.full(1, 255, np.uint8)
    packed = flat[:, 0].astype(np.uint32) << 16 | flat[:, 1].astype(np.uint32) << 8 | flat[:, 2]
    colours = None
    if len(np.unique(packed[:4096])) <= 256:  # else there are more in the whole
        colours, index = np.unique(packed, return_inverse=True)
    coded = None
    if colours is not None and len(colours) <= 256 and 4 * len(colours) <= len(flat):
        steps = np.diff(_channels(colours | np.uint32(0xFF000000)), axis=0, prepend=0).astype(np.uint8)
        parts += [_number_bits((1, 1), (3, 2), (len(colours) - 1, 8), (0, 1))]
        parts += _uniform_image([steps[:, 2], steps[:, 1], steps[:, 3], steps[:, 0]])
        n = len(colours)
        block = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
        per = 1 << block
        rows = index.reshape(height, width).astype(np.uint8)
        rows = np.pad(rows, ((0, 0), (0, -width % per)))
        cells = rows.reshape(height, -1, per)
        bundled = np.zeros(cells.shape[:2], np.uint8)
        for k in range(per):
            bundled |= cells[:, :, k] << np.uint8(k * (8 >> block))
        zero = np.zeros(1, np.uint8)
        channels = [bundled.reshape(-1), zero, zero, opaque]
    else:
        channels = [flat[:, 1], flat[:, 0], flat[:, 2], opaque]
        coded = _coded_image(*channels[:3])
    parts += [_number_bits((0, 1), (0, 1), (0, 1)), *(coded or _uniform_image(channels))]
    body = np.packbits(np.concatenate(parts), bitorder="little").tobytes()
    padded = body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + padded
