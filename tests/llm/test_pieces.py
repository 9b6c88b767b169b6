import zlib

import numpy as np
import pytest
import sentencepiece as sp

from skein.llm import piece_model as pm
from skein.llm import pieces
from skein.llm.common import read

TEXTS = ["", " ", "  a  b ", "é̀🤖x", "\n\t\n", "x" * 3000, "<s> hi </s>", "<0x0A>", "a\x00b", "naïve  straße\r\n ½ ﬁ", "word " * 4000]


@pytest.mark.parametrize("kind", [pm.BPE, pm.UNIGRAM])
@pytest.mark.parametrize("squeeze", [False, True])
def test_parity(kind, squeeze):
    data, model = pm.load()
    model.kind, model.remove_extra_whitespaces = kind, squeeze
    if kind == pm.UNIGRAM:  # plain log-probability-like scores, without ties
        rng = np.random.default_rng(3)
        model.pieces = [(p, float(-rng.uniform(4, 14)) if k == pm.NORMAL else s, k) for p, s, k in model.pieces]
    data = pm.serialize(model)
    theirs = sp.SentencePieceProcessor(model_proto=data)
    encoder = pieces.Encoder(data)
    done = encoder.encode(TEXTS)
    assert [x for x, _ in done] == theirs.encode(TEXTS)
    assert all(ok for _, ok in done)
    assert encoder.decode([x for x, _ in done]) == [theirs.decode(x) for x, _ in done]
    if not squeeze:
        assert encoder.decode([x for x, _ in done]) == TEXTS


def test_frame(spark):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate([*TEXTS, None])] + [(0, "", 1)], "doc_id long, text string, ids int")
    encoded = pieces.encode_pieces(df)
    back = {r.doc_id: r.text for r in pieces.decode_pieces(encoded).collect()}
    assert [back[k] for k in range(len(TEXTS))] == TEXTS and back[len(TEXTS)] == ""
    summary = pieces.encode_summary(df).collect()
    assert len(summary) == len(TEXTS) + 2 and all(r.parity and (r.round_trip or r.doc_id == len(TEXTS)) for r in summary)
    assert pieces.encode_summary(df.limit(0)).count() == 0


def test_parity_sees_the_normaliser():
    encoder = pieces.Encoder(pm.load()[0])
    assert encoder.encode(["a  b"])[0][1]
    encoder.model.remove_extra_whitespaces = not encoder.model.remove_extra_whitespaces
    encoder.made = pieces.rebuild(encoder.model)
    assert not encoder.encode(["a  b"])[0][1] and encoder.encode(["a b"])[0][1]


def test_pieces_across_words():
    """A piece that crosses words is found, since whole texts are encoded."""
    data, model = pm.load()
    model.kind = pm.UNIGRAM
    model.pieces = [*model.pieces[:259], *[(c, -20.0 - k / 64, pm.NORMAL) for k, c in enumerate("\u2581abc")], ("a\u2581b", -1.0, pm.NORMAL)]
    data = pm.serialize(model)
    done = pieces.Encoder(data).encode(["ca b a  c"])
    assert done[0][1] and 263 in done[0][0]


def test_query_against_sentencepiece(spark):
    sf = "/root/testdata/sf0.001"
    proc = sp.SentencePieceProcessor(model_file=pm.MODEL_PATH)
    texts = {r.doc_id: r.text for r in read(spark, sf, "documents").collect()}
    got = pieces.op10_piece_encode(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = proc.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_crc32, r.parity) == (len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()), True)
        assert r.round_trip == (proc.decode(ids) == (texts[r.doc_id] or ""))


def test_threads(spark, monkeypatch):
    """Two threads unless more are asked for; the library reads it from the worker's environment."""
    import os

    for asked, want in ((None, "2"), (3, "3"), (1, "1")):
        pieces._encoder(pm.load()[0], False, asked)
        assert os.environ["RAYON_NUM_THREADS"] == want and os.environ["TOKENIZERS_PARALLELISM"] == ("true" if want != "1" else "false")


def test_unigram_model_on_a_table(spark, tmp_path):
    """The scored lattice over a whole table, with the unigram model that is derived from the ranks."""
    data, model = pm.load()
    model = pm.as_unigram(model)
    with open(f"{tmp_path}/unigram.model", "wb") as f:
        f.write(pm.serialize(model))
    proc = sp.SentencePieceProcessor(model_file=f"{tmp_path}/unigram.model")
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pieces.encode_pieces(docs, f"{tmp_path}/unigram.model").collect():
        assert len(r.ids) == len(proc.encode(texts[r.doc_id]))


def test_decoder_has_spaces_for_marks():
    """Marks are replaced in the pieces, not in the decoded text: a mark that byte pieces spell stays, as in sentencepiece."""
    data, model = pm.load()
    encoder, proc = pieces.Encoder(data, False), sp.SentencePieceProcessor(model_proto=data)
    place = {p: k for k, (p, _, _) in enumerate(model.pieces)}
    for spelt in (["a", "<0xE2>", "<0x96>", "<0x81>", "b"], ["▁", "▁", "a"], ["▁a", "<0xE2>", "a"], []):
        ids = [place[p] for p in spelt]
        assert encoder.decode([ids]) == [proc.decode(ids)]


def test_parts_are_small():
    """At most ROWS texts go to the library at once, and each row comes once."""
    import pyarrow as pa

    texts = [None if k % 50 == 0 else "é" * (k % 7) for k in range(1000)]
    texts[500] = "x" * (5 << 20)
    got = list(pieces._parts(pa.record_batch([pa.array(range(1000)), pa.array(texts)], ["doc_id", "text"]), 1))
    assert [t for _, part in got for t in part] == texts and [k for keys, _ in got for k in keys.to_pylist()] == list(range(1000))
    assert max(len(part) for _, part in got) == 128 and got[3][1][-1] == texts[500]
