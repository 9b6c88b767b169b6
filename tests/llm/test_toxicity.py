import zlib

import numpy as np

from skein.llm import toxicity as tx
from skein.llm.common import read


def test_entries_and_matcher_agree():
    text = "An Idiot's idiots, idiotic! achlichen achlicher mid\nachlich " + "x " * 30
    lexicon = ["idiot", "idiot*", "achlich*@", "mid", "achlich*", "clown"]
    hits = tx.Matcher(lexicon).hits(text)
    assert hits == {0: 1, 1: 3, 2: 3, 3: 1, 4: 3}
    assert {lexicon[k] for k in hits} == tx.entries(text) & set(lexicon)


def test_label_model_finds_accuracies_and_discounts_copies():
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.3).astype(int)
    rates = [(0.6, 0.001), (0.5, 0.002), (0.3, 0.001), (0.2, 0.2)]
    votes = np.column_stack([rng.random(4000) < np.where(y == 1, a, b) for a, b in rates]).astype(float)
    votes = np.column_stack([votes, votes[:, 0], votes[:, 0], votes.sum(axis=1) == 0])
    noisy = np.where(rng.random(4000) < 0.05, 1 - y, y)
    q = tx.label_model(votes, noisy)
    seen = votes[:, :3].any(axis=1)  # rows without a telling vote can only follow their noisy label
    assert ((q > 0.5) == y)[seen].mean() > 0.96 and ((q > 0.5) == y).mean() > 0.9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = tx.op7_toxicity(spark, sf)
    assert out.count() == read(spark, sf, "documents").count()
    rows = out.join(read(spark, sf, "labels"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in rows if r.held_out]
    clean = [r for r in held if r.toxic == 0]
    toxic = [r for r in held if r.toxic == 1]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.75 * len(toxic)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "You idiot, you clown.", 1), (4, "fine", 1), (4, "fine", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = tx.train(docs, labels)
    out = tx.score_texts(docs, model).collect()
    assert len(out) == 5 and [r.predicted for r in out if r.doc_id is None] == [1] and sum(r.predicted for r in out) == 1
    kept = tx.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 4
    assert tx.score_texts(docs.limit(0), model).count() == 0
    long = spark.createDataFrame([(1, "word " * 200000 + "idiot")], "doc_id long, text string")
    assert tx.score_texts(long, model).first().n_hits == 1


def plain_hits(text, lexicon):
    """Entries found by taking the text's words one by one."""
    words = tx.LETTERS.findall(text.lower())
    found = {}
    for k, entry in enumerate(lexicon):
        stem = entry.rstrip("*@")
        times = sum(w.startswith(stem) if "*" in entry else w == stem for w in words)
        if times and ("@" not in entry or (times >= 2 and 1000 * times >= len(text))):
            found[k] = times
    return found


def test_query_against_plain_scores(spark):
    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents")
    model = tx.train(docs, read(spark, sf, "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in tx.op7_toxicity(spark, sf).collect():
        hits, text = plain_hits(texts[r.doc_id], model.lexicon), texts[r.doc_id]
        n = len(model.lexicon)
        x = [0.0] * (n + 3) + list(map(float, tx.patterns(text)))
        for k in hits:
            x[k] = 1.0
        if hits:
            x[n : n + 3] = [1.0, min(len(hits), 4) / 4, np.log1p(min(sum(hits.values()), 50))]
        score = 1 / (1 + np.exp(-(np.dot(x, model.weights) + model.bias)))
        assert abs(score - r.score) < 1e-9 and r.n_hits == sum(hits.values()), r.doc_id
