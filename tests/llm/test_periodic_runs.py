import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from skein.llm import periodic_runs as pr
from skein.llm.suffixes import RangeMin, Suffixes, next_smaller


def brute(words, least=24, power=3):
    """Runs by comparing every word with the one q words on, for every q."""
    n, out = len(words), {}
    for q in range(1, n // power + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(least, power * q):
                out.setdefault((s, i - s + q), q)
    return sorted(((s, m, q) for (s, m), q in out.items()), key=lambda r: (r[0], r[2]))


def periodic(rng, n, k):
    out = []
    while len(out) < n:
        root = [rng.randrange(k) for _ in range(rng.randrange(1, 20))]
        out += root * rng.randrange(1, 9) + root[: rng.randrange(len(root))]
    return out


def test_suffixes():
    rng = random.Random(3)
    for _ in range(50):
        t = np.array([rng.randrange(1, 4) for _ in range(rng.randrange(1, 150))] + [0])
        s = Suffixes(t)
        plain = t.tolist()
        assert s.sa.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
        for _ in range(20):
            i, j = rng.randrange(len(plain)), rng.randrange(len(plain))
            if i != j:
                want = next(k for k in range(len(plain)) if plain[i + k] != plain[j + k])
                assert s.common(np.array([i]), np.array([j]))[0] == want
        isa = s.isa.tolist()
        assert next_smaller(s.isa).tolist() == [next((j for j in range(i + 1, len(isa)) if isa[j] < isa[i]), len(isa)) for i in range(len(isa))]
    v = np.array([rng.randrange(1000) for _ in range(500)])
    lo = np.array([rng.randrange(500) for _ in range(300)])
    hi = np.minimum(499, lo + np.array([rng.randrange(400) for _ in range(300)]))
    assert RangeMin(v).query(lo, hi).tolist() == [v[a : b + 1].min() for a, b in zip(lo, hi, strict=True)]


@pytest.mark.parametrize("least", [3, 6, 24])
def test_against_brute_force(least):
    rng = random.Random(least)
    for _ in range(60):
        texts = [periodic(rng, rng.randrange(150), rng.randrange(1, 5)) if rng.random() < 0.7 else [rng.randrange(3) for _ in range(rng.randrange(100))] for _ in range(rng.randrange(1, 9))]
        got = pr.runs_of([np.array(t, np.int32) for t in texts], least)
        assert [[tuple(r) for r in g.tolist()] for g in got] == [brute(t, least) for t in texts]


def test_large_texts():
    n = 300_000
    assert pr.runs_of([np.zeros(n, np.int32)])[0].tolist() == [[0, n, 1]]
    fib = "0"
    a, b = "1", "0"
    while len(b) < n:
        a, b = b, b + a
    fib = np.frombuffer(b[:n].encode(), np.uint8).astype(np.int32)
    found = pr.runs_of([fib])[0]
    assert len(found) and all((fib[s : s + m - q] == fib[s + q : s + m]).all() for s, m, q in found.tolist())


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute(words)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
    best = (None,) * 4
    for s, m, q in runs:
        if best[0] is None or m * best[2] > best[1] * q:
            best = (s, m, q, 1000 * m // q)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *best, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_against_plain_version(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["a", "b", "é", "c d"]) for _ in range(rng.randrange(120))), "x", "y") for k in range(400)]
    rows += [(None, "a " * 100, None, "y"), (500, None, None, None), (501, "", "x", "y"), (502, " \t\n\x0b", "x", "y"), (503, "z" * 100_000, "x", "y")]
    rows += [(504, "one two\x0cthree\r\n" * 5000, "x", "y"), (504, "one two\x0cthree\r\n" * 5000, "x", "y"), (505, "a b " * 12 + "c " + "a b " * 12, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, n_runs string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in pr.op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((plain_row(r[0], r[1]) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 10
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pr.op13_periodic_runs(spark, f"{tmp_path}/none").count() == 0


def test_operator_keeps_texts(spark):
    df = spark.createDataFrame([("k", "go  go\n" * 20 + "end")], "doc_id string, text string")
    row = pr.collapse(df).first()
    assert (row.doc_id, row.n_words, row.collapsed, [tuple(r) for r in row.runs]) == ("k", 41, "go end", [(0, 40, 1)])
