import itertools
import random
import re

import numpy as np
import pytest

from skein.llm import ngram_join as nj


def shingles(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(words)] if 0 < len(words) < size else (tuple(words[k : k + size]) for k in range(len(words) - size + 1)))


def brute(rows, percent=85, size=4):
    """Components by comparing all pairs; rows are (doc_id, text)."""
    sets = {k: shingles(t, size) for k, t in rows}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_set = {}
    for k, s in sets.items():
        if s:
            by_set.setdefault(s, []).append(k)
    for ids in by_set.values():
        for k in ids:
            a, b = sorted((find(ids[0]), find(k)))
            parent[b] = a
    for (s, x), (t, y) in itertools.combinations([(s, ids[0]) for s, ids in by_set.items()], 2):
        if min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)) and 100 * len(s & t) >= percent * len(s | t):
            a, b = sorted((find(x), find(y)))
            parent[b] = a
    return {k: (len(s), find(k)) for k, s in sets.items()}


def edited(rng, words, rate):
    return [f"new{rng.randrange(10**6)}" if rng.random() < rate else w for w in words]


def check(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, rep string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_components(df, **more).collect()}
    assert got == brute(rows, **more)
    return got


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_common_sizes():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60_000, rng.integers(1, 30_000)).astype(np.uint64)) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = nj.common_sizes(sets, sets)
    assert np.array_equal(got - np.diag(np.diag(got)), np.array(want) - np.diag([len(s) for s in sets]))
    assert nj.common_sizes(sets[:4], sets[4:]).tolist() == [r[4:] for r in want[:4]]


def test_families_and_near_misses(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(120):
        base = words(rng, rng.randrange(5, 200))
        rows += [" ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.05]))) for _ in range(rng.randrange(1, 5))]
    rows += ["", " \n", "One two", "one TWO", "one two three four", "x " * 5000, "x " * 4000]
    got = check(spark, list(enumerate(rows)))
    assert len({c for _, c in got.values()}) < len(rows) - 60


@pytest.mark.parametrize("percent", [70, 85])
def test_large_regions(spark, percent):
    """A family of near copies, some of which link with few others, a chain, and texts that share a template."""
    rng = random.Random(percent)
    base, other, template = words(rng, 150), words(rng, 150), words(rng, 120)
    rows = [" ".join(edited(rng, base, rng.choice([0.0, 0.01, 0.02, 0.03]))) for _ in range(250)]
    rows += [" ".join(edited(rng, template, 0.0) + words(rng, rng.randrange(15, 60))) for _ in range(200)]
    chain = list(other)
    for k in range(130):
        chain[k : k + 1] = [f"step{k}"]
        rows.append(" ".join(chain))
    rng.shuffle(rows)
    check(spark, list(enumerate(rows)), percent=percent)


def test_split_finds_all_links_without_crossing(spark, monkeypatch):
    """Recursion alone, with small limits: every region is split until it is small or stuck."""
    monkeypatch.setattr(nj, "LIMIT", 8)
    monkeypatch.setattr(nj, "PIVOTS", 6)
    monkeypatch.setattr(nj, "BLOCK", 16)
    rng = random.Random(5)
    shared = words(rng, 60)
    rows = []
    for _ in range(30):
        base = shared + words(rng, rng.randrange(20, 90))
        rows += [" ".join(edited(rng, base, 0.01)) for _ in range(rng.randrange(1, 7))]
    check(spark, list(enumerate(rows)))


def test_odd_rows(spark, tmp_path):
    rows = [(None, "a b c d e", 1), (1, "a b c d e", 1), (1, "a b c d e", 1), (2, None, 1), (None, "alone it stands", 1), (3, "q " * 300_000, 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, region int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in nj.op11_ngram_join(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(None, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2), (None, 1, None), (3, 1, 3), (None, 0, None)], key=repr)
    assert nj.ngram_components(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        nj.ngram_components(df, percent=50)


def test_tokens_are_dealt_once(spark):
    """The pivots' count and their join read one shuffle of the prefix shingles, also where the pivots are no broadcast."""
    rows = [(k, 3, np.array([k, k // 2 + 5000, 7], "<i8").tobytes()) for k in range(2000)]
    reps = spark.createDataFrame(rows, "rep long, n_shingles long, prefix binary")
    asked = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = nj._sights(reps)
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", asked)
    assert {r.rep for r in got} == set(range(2000)) and len(got) == len(set(got))
    plan = found._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    dealt = [line for line in plan.splitlines() if "hashpartitioning(token" in line]
    assert len([line for line in dealt if "ReusedExchange" not in line]) == 1 and any("ReusedExchange" in line for line in dealt)
