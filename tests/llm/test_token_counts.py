import random

import pytest
import sentencepiece as sp

from skein.llm import piece_model as pm
from skein.llm import token_counts as tc
from skein.llm.common import read


def brute(word: str, model: pm.PieceModel) -> int:
    """Plain forward scores of one pre-token, without a trie."""
    scores = {p: s for p, s, kind in model.pieces if kind in (pm.NORMAL, pm.USER_DEFINED)}
    best = [(0.0, 0)] + [None] * len(word)
    for d in range(1, len(word) + 1):
        options = [
            (best[k][0] + scores[word[k:d]], -k, best[k][1] + 1) for k in range(d) if word[k:d] in scores
        ]
        if word[d - 1] not in scores:
            cost = len(word[d - 1].encode()) if model.byte_fallback else 1
            options.append((best[d - 1][0] + model.min_score - 10, -d, best[d - 1][1] + cost))
        top = max(options, key=lambda o: (o[0], o[1]))
        best[d] = (top[0], top[2])
    return best[-1][1]


@pytest.fixture(scope="module")
def model():
    data, m = pm.load()
    m.kind = pm.UNIGRAM
    return m


def test_protobuf_round_trip(model):
    assert pm.parse(pm.serialize(model)) == model


def test_trie_against_brute_force_and_library(model):
    small = pm.PieceModel(**vars(model))
    rng = random.Random(5)
    small.pieces = model.pieces[:259] + [("▁", -9.5, 1)] + [(p, -1 - rng.random() * 9, 1) for p, _, _ in model.pieces[260:4000]]
    proc = sp.SentencePieceProcessor()
    proc.LoadFromSerializedProto(pm.serialize(small))
    trie = tc.ForwardTrie(small)
    text = "the then there thermal other é 🤖🤖 naïve straße $$$ don't aaaaaaaaaaaa 1234567890 " + "word" * 40
    for word in text.split():
        pre = tc.PRETOKEN.findall(tc.normalise(word, small))
        assert trie.tokens(pre) == sum(brute(p, small) for p in pre) == len(proc.encode(word)), word


def test_frame(spark):
    rows = [(1, "the the there", "x"), (1, "the the there", "x"), (2, None, "x"), (3, "", "x"), (None, " ", "x"), (5, "a " * 50000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = {(r.doc_id): r for r in tc.count_tokens(df).collect()}
    assert out[2].n_tokens == out[3].n_tokens == 0 and out[1].n_pretokens == 3
    assert out[5].n_pretokens == 50001 and out[5].n_tokens >= 50000
    assert tc.count_tokens(df).count() == 6 and tc.count_tokens(df.limit(0)).count() == 0


def test_query_against_sentencepiece(spark):
    """The registered query's rows: the library counts whole texts under the same derived unigram model."""
    sf = "/root/testdata/sf0.001"
    derived = pm.as_unigram(pm.load()[1])
    assert derived.kind == pm.UNIGRAM and abs(sum(2.718281828459045**s for _, s, k in derived.pieces if k == pm.NORMAL) - 1) < 0.05
    proc = sp.SentencePieceProcessor(model_proto=pm.serialize(derived))
    texts = {r.doc_id: r.text for r in read(spark, sf, "documents").collect()}
    got = tc.op2_token_counts(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.n_tokens == len(proc.encode(texts[r.doc_id] or "")), r.doc_id


def test_restarts_give_the_same_counts(spark):
    rows = [(k, " ".join(f"w{k}x{j} straße" for j in range(300))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(tc.count_tokens(df, max_nodes=500).collect()) == sorted(tc.count_tokens(df).collect())


def test_long_words(model):
    """Words beyond the trie count as in it, and need memory for the longest piece only."""
    import tracemalloc

    trie = tc.ForwardTrie(model)
    rng = random.Random(2)
    for word in ("the" * 900, "a" * 1500, "".join(rng.choice("abcdeé🤖there") for _ in range(3000))):
        assert trie._passing(word) == trie._insert(word)
    trie.reset()
    word = "understanding" * 160_000
    tracemalloc.start()
    n = trie.tokens([word])
    assert tracemalloc.get_traced_memory()[1] < 20 << 20 and n > 160_000 and len(trie.best) == 1
    tracemalloc.stop()


def test_trie_is_bounded_inside_a_text(model):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(30_000)]
    small, large = tc.ForwardTrie(model, 20_000), tc.ForwardTrie(model)
    assert small.tokens(words) == large.tokens(words) and len(small.best) < 20_000 + 9 * tc.STRIDE < len(large.best)
