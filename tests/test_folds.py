"""Order-dependent operators against plain Python versions, and the contracts they keep."""

import json
import os
import random
import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions.json_text import balanced
from skein.functions import text
from skein.plans import registry
from skein.operators import clustering, embedding, meetings, retrieval, sentences
from skein.sources import imports, tables
from skein.streaming import stateful, transcripts


def test_sentences():
    s = "Dr. Smith paid 3.5 dollars, e.g. to J. Doe. Really? Yes! He said (\"go.\") Then it ended"
    found, at = sentences.completed(s, 0)
    assert found == ["Dr. Smith paid 3.5 dollars, e.g. to J. Doe.", "Really?", "Yes!", 'He said ("go.', '") Then it ended'][: len(found)]
    assert s[at:].endswith("ended")
    assert sentences.completed("One. Two", 0) == (["One."], 4) and sentences.completed("One.", 0) == ([], 0)


def test_incremental_equals_whole():
    rng = random.Random(3)
    s = " ".join(rng.choice(["Hi.", "Mr.", "word", "3.14", "Why?", "U.S.", "end!", "A."]) for _ in range(200))
    whole, end = sentences.completed(s, 0)
    got, at = [], 0
    for cut in range(0, len(s) + 1, 7):
        more, at = sentences.completed(s[:cut], at)
        got += more
    more, at = sentences.completed(s, at)
    assert (" ".join(got + more)).replace(" ", "") == " ".join(whole).replace(" ", "") and at == end


def test_chunks_keep_their_contract():
    rng = random.Random(1)
    for _ in range(20):
        body = " ".join(f"{'w ' * rng.randrange(1, 60)}end." for _ in range(rng.randrange(1, 80)))
        chunks = sentences.chunk_text(body)
        assert all(n <= 200 for _, _, n in chunks)
        starts = [at for _, at, _ in chunks]
        assert starts == sorted(starts) and len(set(starts)) == len(starts)
        assert chunks[0][1] == 0 and chunks[-1][0].split()[-1] == body.split()[-1]
    assert sentences.chunk_text("") == []
    assert [n for _, _, n in sentences.chunk_text("w " * 500)] == [200, 200, 100]
    assert sentences.as_of([0, 10], ["a", "b"], 9) == "a" and sentences.as_of([5], ["x"], 0) == "x" and sentences.as_of([], [], 3) is None


def test_mmr_prefers_diversity_and_floors_at_zero():
    q, a, b, c = np.array([1.0, 0, 0]), np.array([0.9, 0.436, 0]), np.array([0.89, 0.456, 0]), np.array([0.6, -0.8, 0])
    pool = [(1, a), (2, b), (3, c)]
    assert retrieval.mmr_order(q, pool, 2, 0.5) == [1, 3] and retrieval.mmr_order(q, pool, 2, 1.0) == [1, 2]
    assert retrieval.mmr_order(q, [(7, None), (8, a), (9, None)], 2) == [7, 8]
    assert retrieval.mmr_order(q, [(7, None), (8, a), (9, b)], 3) == [8, 9, 7]


def test_clusters():
    axes = np.eye(4)
    v = np.array([axes[k // 3] + 0.05 * axes[(k // 3 + 1) % 4] * (k % 3) for k in range(12)])
    v /= np.linalg.norm(v, axis=1)[:, None]
    assert clustering.GreedyClusters().add(v) == [k // 3 for k in range(12)]


def test_assembly_batch_equals_stream(spark):
    rows = [
        ("a", 0, "Hello", True, 0.0, 2.0), ("a", 1, "Hello world", True, 0.0, 3.0), ("a", 2, "hello world ", True, 0.5, 3.0), ("a", 3, "volatile", False, 3.0, 4.0),
        ("a", 4, "Next", True, 3.0, 5.0), ("a", 5, "Ne", True, 3.5, 4.5), ("a", 6, "Other", True, 3.5, 4.5), ("b", 0, "", True, 0.0, 1.0), ("b", 1, "Yes", True, 0.2, 1.5),
    ]
    df = spark.createDataFrame(rows, "session_id string, seq long, text string, is_final boolean, start double, end double")
    batch = sorted(tuple(r) for r in meetings.assemble(df).collect())
    assert [r[2] for r in batch] == ["Hello world", "Next", "Other", "Yes"]
    folder = tempfile.mkdtemp(prefix="spark-updates-")
    for k, part in enumerate((rows[:3], rows[3:6], rows[6:], rows[1:5])):  # the last ones come again
        with open(f"{folder}/{k}.json", "w") as f:
            f.writelines(json.dumps(dict(zip(df.columns, r))) + "\n" for r in part)
        os.utime(f"{folder}/{k}.json", (1_700_000_000 + 10 * k,) * 2)  # files are taken by their times
    seen: dict = {}

    def keep(out, number):
        for r in out.collect():
            seen[(r.session_id, r.line)] = (r.text, r.start, r.end)

    stream = stateful.assemble_stream(transcripts.read_updates(spark, folder))
    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-marks-")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((s, n, *v) for (s, n), v in seen.items()) == batch


def test_windows_and_summary_calls():
    windows = meetings.plan_windows([[3000]] * 20)
    assert windows == [6001] * 10 and all(meetings.tokens_of_size(w) <= meetings.WINDOW_TOKENS for w in windows)
    assert meetings.plan_windows([[1], [3400] * 5, [1]]) == [1, 6802, 6802, 3400, 1]
    assert meetings.plan_windows([[9000], [5]]) == [9000, 5]
    assert meetings.summary_calls([5]) == [] and [c[0] for c in meetings.summary_calls([700])] == ["reduce"]
    stages = [c[0] for c in meetings.summary_calls([7000] * 60)]
    assert stages.count("map") == 60 and stages.count("merge0") == 9 and stages.count("merge1") == 2 and stages[-1] == "reduce"


def plain_clusters(vectors, threshold):
    sums, out = [], []
    for v in vectors:
        best, top = -1, threshold
        for n, s in enumerate(sums):
            cosine = float(np.dot(s / np.linalg.norm(s), v))
            if cosine >= top:
                best, top = n, cosine
        if best < 0:
            best = len(sums)
            sums.append(np.zeros(len(v)))
        sums[best] = sums[best] + v
        out.append(best)
    return out


@pytest.mark.parametrize("block", [1, 7, 256])
def test_a_large_group_is_a_stream(spark, monkeypatch, block):
    """Blocks and batches of any size give the plain fold's clusters."""
    monkeypatch.setattr(clustering, "BLOCK", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rng = np.random.default_rng(block)
        v = rng.normal(size=(900, 6)) + 3 * np.eye(6)[rng.integers(0, 6, 900)]
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        rows = [(k % 2, k, x.tolist()) for k, x in enumerate(v)] + [(0, 5000, None)]
        df = spark.createDataFrame(rows, "grp long, id long, vector array<double>").repartition(5)
        got = {r.id: r.cluster for r in clustering.cluster(df, 0.7).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in (0, 1):
        ids = sorted((k for k in range(900) if k % 2 == g), key=str)
        assert [got[k] for k in ids] == plain_clusters(v[ids], 0.7)
    assert len(got) == 900 and len(set(got.values())) > 5


def test_json_and_imports(spark):
    assert balanced('noise "{" {"a": "}", "b": {"c": 1}} tail') == '{"a": "}", "b": {"c": 1}}' or balanced('x {"a": "}"} y') == '{"a": "}"}'
    assert balanced("none { here") is None
    df = spark.createDataFrame([(bytearray("naïve".encode()),), (bytearray(b"it\x92s"),), (bytearray(b"\x81"),), (None,)], "content binary")
    assert [r[0] for r in df.select(imports.decode(F.col("content"))).collect()] == ["naïve", "it’s", "\x81", None]
    row = spark.range(1).select(
        text.clean(F.lit("a-\r\nb  c \n\n\n\nd\x07 ")).alias("c"), text.duration(F.lit(3725.9)).alias("d"), text.clock(F.lit(-5.0)).alias("k"), text.file_name(F.lit(" ")).alias("n")
    ).first()
    assert tuple(row) == ("ab c\n\nd", "1h 2m 5s", "00:00:00", "Session")


def test_tables_functions(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, title string")
    new = spark.createDataFrame([(2, "B"), (9, "Z")], "id long, title string")
    assert sorted(map(tuple, tables.update(old, new, "id", ["title"]).collect())) == [(1, "a"), (2, "B")]
    kept, orphans = tables.split_orphans(new, old, "id")
    assert [r.id for r in kept.collect()] == [2] and [r.id for r in orphans.collect()] == [9]


def test_partitions_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    q = docs.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    a, b = (sorted(map(tuple, retrieval.bm25(q, docs.repartition(n)).collect())) for n in (1, 7))
    assert a == b and a
    v = embedding.embed(docs)
    q = v.filter("id % 50 = 0 and vector is not null").select(F.col("id").alias("query_id"), "vector")
    a, b = (sorted(map(tuple, retrieval.vector_top_k(q, v.repartition(n), 5).collect())) for n in (1, 7))
    assert a == b and all(r[3] <= 5 for r in a)


# Plain versions of the queries that no SQL states, compared row by row on the smallest tables.

SF = "/root/testdata/sf0.001"


def plain_sentences(text):
    """Cut at terminators before blanks, closers allowed between, unless a title, an initial or a dotted abbreviation ends there."""
    out = []
    for line in text.split("\n"):
        start = 0
        for k, c in enumerate(line):
            if c not in ".!?":
                continue
            after = line[k + 1 :].lstrip("\"')\u201d")
            if after and after[0] != " ":
                continue
            word = re.split(r"[\W\d_]", line[max(0, k - 40) : k])[-1]
            if c == "." and ((k >= 2 and line[k - 2] == ".") or (len(word) == 1 and word.isupper()) or word.lower() in sentences.TITLES):
                continue
            out.append(line[start : k + 1].strip())
            start = k + 1
        out.append(line[start:].strip())
    return [s for s in out if s]


def plain_chunks(text):
    units = []
    for s in plain_sentences(text):
        words = s.split()
        units += [words[k : k + 200] for k in range(0, len(words), 200)] if len(words) > 300 else [words]
        if len(words) <= 300:
            units[-1] = s
    size = [len(u) if isinstance(u, list) else len(u.split()) for u in units]
    spelt = [" ".join(u) if isinstance(u, list) else u for u in units]
    out, at = [], 0
    while at < len(units):
        end = at + 1
        while end < len(units) and sum(size[at : end + 1]) <= 200:
            end += 1
        out.append((" ".join(spelt[at:end]), sum(size[at:end])))
        if end == len(units):
            break
        back = end
        while back > at + 1 and sum(size[back:end]) < 40:
            back -= 1
        at = back
    return out


def plain_vector(text):
    import hashlib

    v = [0.0] * 64
    for w in text.lower().split():
        h = hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        v[int.from_bytes(h[:4], "little") % 64] += 1 if h[4] & 1 else -1
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n > 1e-6 else None


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_chunk_queries(spark, texts):
    import hashlib

    found = registry.queries()
    want = sorted((i, k, n, hashlib.md5(c.encode()).hexdigest()) for i, t in texts.items() for k, (c, n) in enumerate(plain_chunks(t)))
    assert sorted((r.id, r.chunk_index, r.words, r.text_md5) for r in found["ir_8_chunk_documents"](spark, SF).collect()) == want
    assert sorted((r.id, r.chunk_index, r.words) for r in found["ir_10_index_build"](spark, SF).collect() if r.dim == 64) == [w[:3] for w in want]
    rebuilt = {(r.source_type, r.source_id): (r.status, r.chunks, r.words) for r in found["snk_8_rebuild"](spark, SF).collect()}
    for i in texts:
        mine = [n for j, _, n, _ in want if j == i]
        assert rebuilt.pop(("document", i)) == ("ready", len(mine), sum(mine))
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append(r.text or "")
    want = sorted((i, k, n, hashlib.md5(c.encode()).hexdigest()) for i, t in turns.items() for k, (c, n) in enumerate(plain_chunks(" ".join(t))))
    for i in turns:
        mine = [n for j, _, n, _ in want if j == i]
        assert rebuilt.pop(("session", i)) == ("ready", len(mine), sum(mine))
    assert not rebuilt
    assert sorted((r.session_id, r.chunk_index, r.words, r.text_md5) for r in found["ir_9_chunk_sessions"](spark, SF).collect()) == want


def test_embedding_queries(spark, texts):
    found = registry.queries()
    made = {r.id: r.vector for r in embedding.embed(spark.createDataFrame(list(texts.items()), "id long, text string")).collect()}
    for i, t in texts.items():
        want = plain_vector(t)
        assert (made[i] is None) == (want is None) and (want is None or np.allclose(made[i], want, atol=1e-6))
    assert {r.id: r.squared for r in found["ir_11_embed"](spark, SF).collect()} == {i: None if v is None else 1.0 for i, v in made.items()}
    chunks = [(i, plain_vector(c)) for i, t in sorted(texts.items()) if len(t) >= 20 for c, _ in plain_chunks(t)]
    matrix = np.array([v if v is not None else [0.0] * 64 for _, v in chunks], np.float32).astype(float)
    misses = []
    asked = [i for i, t in texts.items() if i % 100 == 0 and len(t) >= 20]
    for i in asked:
        s = np.round(matrix @ np.array(plain_vector(texts[i][:400]), np.float32).astype(float), 6)
        if i not in [chunks[k][0] for k in sorted(range(len(s)), key=lambda k: (-s[k], k))[:6]]:
            misses.append(i)
    r = found["ir_23_self_retrieval"](spark, SF).first()
    assert (r.hit_rate, r.misses) == (round(1 - len(misses) / len(asked), 6), misses)


def test_sentence_query(spark, texts):
    import hashlib

    for r in registry.queries()["str_4_sentences"](spark, SF).collect():
        parts, at = sentences.completed(texts[r.doc_id], 0)
        tail = texts[r.doc_id][at:].strip()
        want = parts + ([tail] if tail else [])
        assert (r.n, r.md5) == (len(want), hashlib.md5("|".join(want).encode()).hexdigest())
        assert "".join("".join(want).split()) == "".join(texts[r.doc_id].split())  # nothing is lost
