import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein.llm import mixing


def targets_by_rounds(sizes):
    """The contract's own procedure: share by weight, stop at three sizes, reshare the excess."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, free, rest = {}, set(sizes), sum(sizes.values())
    while free:
        share = {s: (rest - sum(target.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return target


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = []
    for k in range(900):
        source = rng.choice(["a", "b", "b", "b", "b", "z", "é", "ab", None])
        out.append((k, source, " ".join(["w"] * (rng.randrange(1, 300) if source != "a" else rng.randrange(1, 8))), "x"))
    out += [(1000, "b", None, "x"), (1001, "b", "", "x"), (1002, None, " \t ", "x"), (5, *out[5][1:]), (5, *out[5][1:])]
    return out


def test_targets_and_takings(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size string").repartition(4)
    got = mixing.mix_draws(df, block_docs=16, shard_words=8000).collect()
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.size * len(r.draws)
        assert len(r.draws) <= 3 and (r.size or not r.draws)
    want = targets_by_rounds(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(20, 0.01 * want[s]), (s, taken[s], want[s])
    again = mixing.mix_draws(df.repartition(7), block_docs=16, shard_words=8000).collect()
    key = lambda r: (r.doc_id, r.row_key, tuple(map(tuple, r.draws)))
    assert sorted(map(key, got)) == sorted(map(key, again))
    shards = Counter(d.shard for r in got for d in r.draws)
    assert len(shards) == -(-sum(sizes.values()) // 8000)


def test_tree_splits_exactly(spark):
    q = [(0, 1000), (1, 17), (2, 0), (3, 333)]
    one = spark.createDataFrame([(q,)], "q array<struct<rank:int,n:bigint>>")
    got = mixing._split_tree(one, 6, 9).collect()
    per_source, per_shard = Counter(), Counter()
    for r in got:
        assert r.quota >= 0
        per_source[r["rank"]] += r.quota
        per_shard[r.shard] += r.quota
    assert dict(per_source) == {k: n for k, n in q if n}
    assert sorted(per_shard) == list(range(6)) and max(per_shard.values()) - min(per_shard.values()) <= 3
    first = {r.shard: r.quota for r in got if r["rank"] == 0}
    assert all(abs(n - 1000 / 6) < 60 for n in first.values()) and len(set(first.values())) > 1


def test_bundles_keep_quotas(spark, monkeypatch):
    """Nodes that draw bundles: quotas stay exact, shards differ by less than the bundles drawn on their way."""
    monkeypatch.setattr(mixing, "DRAWN", 64)
    monkeypatch.setattr(mixing, "SPREAD", 2)
    q = [(0, 10_000), (1, 170), (2, 3_333)]
    got = mixing._split_tree(spark.createDataFrame([(q,)], "q array<struct<rank:int,n:bigint>>"), 24, 9).collect()
    per_source, per_shard = Counter(), Counter()
    for r in got:
        per_source[r["rank"]] += r.quota
        per_shard[r.shard] += r.quota
    assert dict(per_source) == dict(q) and sorted(per_shard) == list(range(24))
    assert max(per_shard.values()) < 1.6 * 13_503 / 24 and min(per_shard.values()) > 13_503 / 24 / 1.6


def test_draws_do_not_depend_on_sizes(spark, monkeypatch):
    """Large nodes draw as small ones do: walks in several sequences give the same, counts are spread as the hypergeometric ones."""
    q = [(0, 10_000), (1, 170), (2, 3_333)]
    one = spark.createDataFrame([(q,)], "q array<struct<rank:int,n:bigint>>")
    whole = sorted(map(tuple, mixing._split_tree(one, 24, 9).collect()))
    monkeypatch.setattr(mixing, "DRAWN", 64)
    assert sorted(map(tuple, mixing._split_tree(one, 24, 9).collect())) == whole
    monkeypatch.undo()
    for n in (20, 90_000):
        q = spark.createDataFrame([([(0, n), (1, n)],)], "q array<struct<rank:int,n:bigint>>")
        counts = [r.quota for seed in range(24) for r in mixing._split_tree(q, 2, seed).filter("shard = 0 and rank = 0").collect()]
        spread = (n / 4 * n / (2 * n - 1)) ** 0.5
        away = [(c - n / 2) / spread for c in counts]
        assert len(away) == 24 and abs(sum(away)) < 4 * 24**0.5 and 0.3 < sum(a * a for a in away) / 24 < 2.3


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "w w", 1, 2, 3), (2, "b", "w", 4, 5, 6)], "doc_id long, source string, text string, row_key int, draw int, draws int")
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and set(mixed.collect()) <= set(df.collect()) and mixed.count()


def test_mix_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size string")
    times = {(r.doc_id, r.row_key): len(r.draws) for r in mixing.mix_draws(df).collect()}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    got = Counter(r.doc_id for r in mixed.collect())
    want = Counter()
    for k, row in enumerate(rows):
        want[row[0]] += next(n for (i, _), n in times.items() if i == row[0])
    assert got == +want


def test_empty_and_native(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix_draws(df).count() == 0 and mixing.mix(df).count() == 0
    nothing = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")
    assert [(r.target, r.draws) for r in mixing.mix_draws(nothing).collect()] == [(0.0, []), (0.0, [])]
    long = spark.createDataFrame([(1, "a", "w " * 300000), (2, "b", "w")], "doc_id long, source string, text string")
    plan = mixing.mix_draws(long)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert mixing.mix_draws(long).agg(F.sum("source_size")).first()[0] == 300001


def test_long_document_in_the_boundary_block(spark):
    """Wherever the one long document lies, what is missing is less than any document not taken in the partial pass."""
    for seed in (1, 2):
        rows = [(k, "a", "w " * 10) for k in range(400)] + [(400, "a", "w " * 3900), (401, "b", "w " * 3000), (402, "c", "w " * 2600)]
        df = spark.createDataFrame(rows, "doc_id long, source string, text string")
        got = [r for r in mixing.mix_draws(df, weights=(4.0, 4.0, 4.0), block_docs=16, seed=seed).collect() if r.source == "a"]
        target = got[0].target
        taken = sum(r.size * len(r.draws) for r in got)
        assert target < sum(r.size for r in got)
        left = [r.size for r in got if not r.draws]
        assert all(len(r.draws) <= 1 for r in got) and 0 <= round(target) - taken < min(left)
