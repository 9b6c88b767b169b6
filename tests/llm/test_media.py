import hashlib
import random
import zlib

import numpy as np
import pytest

from skein.llm import media, webp
from tests.llm import webp_writer as ww


def picture(width, height, seed, colours=None):
    rng = np.random.default_rng(seed)
    flat = rng.integers(0, 256, (height * width, 4))
    if colours:
        flat = flat[rng.integers(0, colours, height * width)]
    smooth = (np.cumsum(flat // 60, axis=0) + 40) % 256
    return (flat if colours else smooth).astype(np.int64)  # alpha, red, green, blue


def argb(c):
    return [int(a << 24 | r << 16 | g << 8 | b) for a, r, g, b in c.tolist()]


def expect(c, width):
    return c.reshape(-1, width, 4)[..., [1, 2, 3, 0]].astype(np.uint8)


@pytest.mark.parametrize("cache,refs,groups,colours", [(0, False, 0, None), (5, False, 0, 40), (0, True, 0, 6), (7, True, 2, 50), (3, True, 3, 300)])
def test_codes_references_cache_groups(cache, refs, groups, colours):
    c = picture(23, 17, cache + groups, colours)
    out = ww.start(23, 17)
    out.put(0, 1)
    ww.put_image(out, argb(c), 23, True, cache, refs, groups)
    assert (webp.decode(ww.container(out)) == expect(c, 23)).all()


def forward_predict(c, width, height, mode_of):
    """Residuals by the definitions, pixel by pixel."""
    p = c.reshape(height, width, 4).tolist()
    out = []
    for y in range(height):
        for x in range(width):
            left = p[y][x - 1] if x else None
            if y == 0:
                base = [255, 0, 0, 0] if x == 0 else left
            elif x == 0:
                base = p[y - 1][0]
            else:
                up, lup = p[y - 1][x], p[y - 1][x - 1]
                rup = p[y - 1][x + 1] if x + 1 < width else p[y][0]
                avg = lambda a, b: [(i + j) // 2 for i, j in zip(a, b)]
                m = mode_of(x, y)
                if m == 11:
                    pred = [i + j - k for i, j, k in zip(left, up, lup)]
                    dl = sum(abs(i - j) for i, j in zip(pred, left))
                    du = sum(abs(i - j) for i, j in zip(pred, up))
                    base = left if dl < du else up
                elif m == 13:
                    base = [min(255, max(0, i + int((i - j) / 2))) for i, j in zip(avg(left, up), lup)]
                else:
                    base = [
                        [255, 0, 0, 0], left, up, rup, lup, avg(avg(left, rup), up), avg(left, lup), avg(left, up), avg(lup, up),
                        avg(up, rup), avg(avg(left, lup), avg(up, rup)), None,
                        [min(255, max(0, i + j - k)) for i, j, k in zip(left, up, lup)],
                    ][m]
            out.append([(i - j) % 256 for i, j in zip(p[y][x], base)])
    return np.array(out)


@pytest.mark.parametrize("modes", [*([m] for m in range(14)), list(range(14)), [0, 2, 4], [1]])
def test_predictor(modes):
    width, height, bits = 21, 14, 2
    c = picture(width, height, 9)
    across, down = 6, 4
    grid = [modes[k % len(modes)] for k in range(across * down)]
    rest = forward_predict(c, width, height, lambda x, y: grid[(y >> bits) * across + (x >> bits)])
    out = ww.start(width, height)
    out.put(1, 1)
    out.put(0, 2)
    out.put(bits - 2, 3)
    ww.put_image(out, [m << 8 for m in grid], across, False)
    out.put(0, 1)
    ww.put_image(out, argb(rest), width, True)
    assert (webp.decode(ww.container(out)) == expect(c, width)).all()


def test_cross_colour_and_subtract_green():
    width, height, bits = 13, 11, 3
    c = picture(width, height, 4)
    across, down = 2, 2
    rng = random.Random(2)
    mult = [[255, rng.randrange(256), rng.randrange(256), rng.randrange(256)] for _ in range(across * down)]
    s = lambda v: v - 256 if v > 127 else v
    green = c.copy()
    green[:, 1] = (c[:, 1] - c[:, 2]) % 256
    green[:, 3] = (c[:, 3] - c[:, 2]) % 256
    cross = green.copy()
    for k, (_, r, g, b) in enumerate(green.tolist()):
        _, rb, gb, gr = mult[(k // width >> bits) * across + (k % width >> bits)]
        cross[k, 1] = (r - (s(gr) * s(g) >> 5)) % 256
        cross[k, 3] = (b - (s(gb) * s(g) >> 5) - (s(rb) * s(r) >> 5)) % 256
    out = ww.start(width, height)
    out.put(1, 1)
    out.put(2, 2)
    out.put(1, 1)
    out.put(1, 2)
    out.put(bits - 2, 3)
    ww.put_image(out, argb(np.array(mult)), across, False)
    out.put(0, 1)
    ww.put_image(out, argb(cross), width, True, 4, True)
    assert (webp.decode(ww.container(out)) == expect(c, width)).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 16, 17, 200])
def test_palette(colours):
    width, height = 19, 30
    rng = np.random.default_rng(colours)
    palette = rng.integers(0, 256, (colours, 4))
    index = rng.integers(0, colours, height * width)
    steps = np.diff(palette, axis=0, prepend=0) % 256
    block = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    per, rows = 1 << block, []
    for line in index.reshape(height, width):
        for k in range(0, width, per):
            rows.append(255 << 24 | sum(int(v) << (j * (8 >> block)) for j, v in enumerate(line[k : k + per])) << 8)
    out = ww.start(width, height)
    out.put(1, 1)
    out.put(3, 2)
    out.put(colours - 1, 8)
    ww.put_image(out, argb(steps), colours, False)
    out.put(0, 1)
    ww.put_image(out, rows, -(-width // per), True, refs=True)
    assert (webp.decode(ww.container(out)) == expect(palette[index], width)).all()


def test_writer_round_trips():
    rng = random.Random(1)
    for payload in [b" " * 192, bytes(range(192)), bytes(range(256)) * 3, b"ab" * 9600, bytes(rng.randrange(256) for _ in range(192 * 50)), b"abc" * 64 * 300, b"q" * 192 * 17000]:
        assert media.from_media(media.to_media(payload))[..., :3].tobytes() == payload
    for bad in (b"", b"RIFF0000WEBP", media.to_media(b"a" * 192)[:-9]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(bad)


def test_frame(spark):
    texts = [None, "", "é" * 96, "a" * 192, "word " * 300, "word " * 300]
    df = spark.createDataFrame([(k, t, b"x") for k, t in enumerate(texts)], "doc_id long, text string, media binary")
    out = {r.doc_id: r for r in media.read_media(media.encode_media(df)).collect()}
    for k, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        r = out[k]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        stored = media.to_media(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert out[4][1:] == out[5][1:] and out[0][1:] == out[1][1:]
    assert media.read_media(media.encode_media(df.limit(0))).count() == 0


def test_most_rows_go_through_prefix_codes(spark, monkeypatch):
    """Codes of several lengths store and read nearly all documents; the others are as short in codes of one length."""
    taken = {"_coded_pixels": 0, "_uniform_pixels": 0}
    for name in taken:

        def counted(*args, name=name, work=getattr(webp, name)):
            taken[name] += 1
            return work(*args)

        monkeypatch.setattr(webp, name, counted)
    raw = [(r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    payloads = [d + b" " * (-len(d) % 192 if d else 192) for d in raw]
    stored = [media.to_media(p) for p in payloads]
    for p, m in zip(payloads, stored, strict=True):
        assert np.ascontiguousarray(media.from_media(m)[..., :3]).tobytes() == p
    assert taken["_coded_pixels"] > 0.85 * len(raw)
    assert sum(map(len, stored)) < 0.6 * sum(map(len, payloads))


def test_prefix_codes_of_any_shape(monkeypatch):
    rng = np.random.default_rng(5)
    for ahead in (1 << 9, 1 << 17):
        monkeypatch.setattr(webp, "_AHEAD", ahead)  # stretches of bits end anywhere in a pixel
        for k in range(60):
            shape = (int(rng.integers(1, 40)), int(rng.integers(1, 70)), 3)
            draw = [rng.integers(0, 256, shape), rng.zipf(1.3, shape).clip(0, 255), np.full(shape, 7), rng.integers(0, 3, shape) * 50, rng.geometric(0.05, shape).clip(0, 255)][k % 5]
            found = webp.decode(webp.encode_rgb(draw.astype(np.uint8)))
            assert (found[..., :3] == draw).all() and (found[..., 3] == 255).all()
    for counts in ({1: 1, 2: 1}, {k: 2**k for k in range(30)}, {k: 1 for k in range(256)}):
        length = webp.code_lengths(counts, 11)
        assert max(length.values()) <= 11 and sum(2.0 ** -n for n in length.values()) == 1
        codes = webp.canonical(length)
        assert len({(codes[s], length[s]) for s in codes}) == len(codes)


def test_a_short_stream_is_refused():
    data = webp.encode_rgb(np.random.default_rng(1).geometric(0.05, (40, 64, 3)).clip(0, 255).astype(np.uint8))
    cut = data[: len(data) // 2]
    cut = cut[:4] + (len(cut) - 8).to_bytes(4, "little") + cut[8:16] + (len(cut) - 20).to_bytes(4, "little") + cut[20:]
    with pytest.raises(ValueError, match="early"):
        webp.decode(cut)
