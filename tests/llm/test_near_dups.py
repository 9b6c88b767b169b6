import random
import re

import numpy as np

from skein.llm import near_dups as nd
from skein.llm import shingles as sh
from skein.llm.common import read

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Components by comparing all pairs of plain sets."""
    sets = [(i, plain_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def test_shingles_against_plain_sets():
    rng = random.Random(4)
    texts = ["", " \t\n", "One", "a b c d", "A B c D e", "a b c d e f a b c d e f", "é Ünï\x0bx\x85y \x1cz  q", "x" * 70000 + " y"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(50)]
    for t in texts:
        assert len(sh.shingle_set(t)) == len(plain_set(t)), t
    assert (sh.shingle_set("A b C d E f") == sh.shingle_set("a  B c\nd e F")).all()


def test_signature_estimates_similarity():
    a = sh.mix(np.arange(1000, dtype=np.uint64))
    b = sh.mix(np.arange(100, 1100, dtype=np.uint64))
    m = sh.MinHash(1024)
    assert abs((m.signature(a) == m.signature(b)).mean() - 900 / 1100) < 0.05


def test_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.randrange(6, 160))]
        for _ in range(rng.choice([1, 2, 5, 160 if base == 3 else 9])):
            copy = [rng.choice(words) if rng.random() < rng.choice([0, 0.005, 0.01, 0.03]) else w for w in text]
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", "  ", "one two", "One  Two", "one"])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, sig string").repartition(5)
    want = brute(rows)
    got = nd.near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)
    left = nd.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for _, c in want.values()})


def test_edges(spark):
    df = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, "q r s"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), (r.component_id or -1), r.kept) for r in nd.near_duplicates(df).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (-1, 7, False), (7, 7, True), (7, 7, True)]
    assert nd.near_duplicates(df.limit(0)).count() == 0


def test_table_has_no_missed_links(spark):
    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    for r in nd.op8_near_duplicates(spark, sf).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_template_keeps_every_link(spark):
    """Texts that share most of a template, with planted pairs just above the threshold, in nodes that stay large."""
    rng = random.Random(3)
    rows = []
    for k in range(1500):
        shared = 165 if k % 3 else 172
        text = [f"t{j}" for j in range(shared)] + [f"u{rng.randrange(10**9)}" for _ in range(200 - shared)]
        cut = rng.choice([9, 11, 13, 14, 15])
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text[: 200 - cut] + [f"v{rng.randrange(10**9)}" for _ in range(cut)]))]
    sets = {i: sh.shingle_set(t) for i, t in rows}
    linked = {k for k in range(1500) if nd._linked(sets[2 * k], sets[2 * k + 1], 85)}
    assert len(linked) > 1400
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert {i for i, c in got.items() if i != c} == {2 * k + 1 for k in linked}
    assert all(got[2 * k + 1] == 2 * k for k in linked)


def test_large_family_against_brute_force(spark):
    """One family of copies, many of them just above or below the threshold of others."""
    rng = random.Random(6)
    base = [f"b{j}" for j in range(120)]
    rows = []
    for k in range(900):
        text = list(base)
        for _ in range(rng.randrange(1, 5)):
            text[rng.randrange(120)] = f"m{rng.randrange(40)}"
        rows.append((k, " ".join(text)))
    want = brute(rows)
    assert 1 < len({c for _, c in want.values()}) < 800
    for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect():
        assert r.component_id == want[r.doc_id][1], r
