import os
from collections import Counter

import corpus_pipeline as cp
import sentencepiece as sp
from skein.llm import piece_model as pm
from pyspark.sql import Row
from skein.llm import pii, toxicity
from skein.llm.common import read
from tests.llm import plain_pii as plain
from tests.llm.test_near_dups import WORD, brute

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stages_against_plain_versions(spark):
    docs = read(spark, SF, "documents")
    names = docs.columns
    scored = {r.doc_id: r.predicted for r in toxicity.op7_toxicity(spark, SF).collect()}
    one = cp.drop_toxic(spark, docs, SF).cache()
    assert one.columns == names and rows(one) == sorted(tuple(r) for r in docs.collect() if not scored[r.doc_id])
    two = cp.drop_near_duplicates(spark, one, SF).cache()
    want = brute([(r.doc_id, r.text) for r in one.collect()])
    assert two.columns == names and sorted(r.doc_id for r in two.collect()) == sorted({c for _, c in want.values()})
    three = cp.pseudonymise(spark, two, SF).cache()
    old = {r.doc_id: r for r in two.collect()}
    assert three.columns == names and three.count() == two.count()
    for r in three.collect():
        text = plain.pseudonymise(old[r.doc_id].text, pii.job_key(spark))
        assert r == Row(**old[r.doc_id].asDict() | {"text": text, "n_chars": text and len(text)}) or not text
        assert r.n_chars == (None if r.text is None else len(r.text))
    four = cp.mix_sources(spark, three, SF).cache()
    assert four.columns == names
    source = {r.doc_id: r for r in three.collect()}
    size = {i: len(WORD.findall(r.text or "")) for i, r in source.items()}
    times = Counter(r.doc_id for r in four.collect())
    assert all(r == source[r.doc_id] for r in four.collect()) and max(times.values()) <= 3
    total = Counter()
    for i, r in source.items():
        total[r.source] += size[i]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(total))}
    target, free = {}, set(total)
    while True:
        rest = sum(total.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * total[s] for s in over}
        free -= over
    taken = Counter()
    for i, n in times.items():
        taken[source[i].source] += n * size[i]
    for s in total:  # what is missing is less than any document that could still be taken once more
        own = [i for i in source if source[i].source == s and size[i]]
        most = max(times[i] for i in own)
        spare = [size[i] for i in own if times[i] < most] or [size[i] for i in own]
        assert -1 <= target[s] - taken[s] <= min(spare), (s, taken[s], target[s])
    five = cp.encode(spark, four, SF)
    proc = sp.SentencePieceProcessor(model_file=pm.MODEL_PATH)
    tokens = {i: len(proc.encode(r.text or "")) for i, r in source.items()}
    got = five.collect()
    assert Counter(r.doc_id for r in got) == times
    assert all(r.n_tokens == tokens[r.doc_id] and r.parity for r in got)


def test_run(spark):
    assert cp.run(spark, SF).count() > 0
    assert cp.ORACLE_SQL is None and [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "sentencepiece"]


def odd_documents(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns with the operators' own names."""
    long = "long text with many words, and a mail a.b@example.org in it. " * 20_000
    rows = [
        (1, None, None, None, None, 1, "x"), (2, "", "en", "s", 0, 1, "x"), (None, "no id, but a text of more than five words", "en", "s", 41, 1, "x"),
        (3, "the same text in two rows, twice over", "en", "s", 37, 1, "x"), (3, "the same text in two rows, twice over", "en", "s", 37, 1, "x"),
        (4, "the same text in two rows, twice over", "de", None, 37, 2, "y"), (5, long, "en", "t", len(long), 1, "x"), (6, " \t\n", "en", "t", 3, 1, "x"),
        (7, "password: correcthorsebattery", "en", "t", 29, 1, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rep long, found string").withColumnRenamed("rep", "size")


def test_stages_take_odd_rows(spark, tmp_path):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(1, 8)] + [(None, None, None), (2, None, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_documents(spark)
    kept = cp.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == 9
    unique = cp.drop_near_duplicates(spark, kept, str(tmp_path))
    left = sorted((r.doc_id or 0) for r in unique.collect())
    assert unique.columns == docs.columns and left == [0, 1, 2, 3, 3, 5, 6, 7]
    made = cp.pseudonymise(spark, unique, str(tmp_path))
    rows_of = {r.doc_id: r for r in made.collect()}
    assert made.columns == docs.columns and rows_of[1].text is None and rows_of[2].text == "" and rows_of[7].text != "password: correcthorsebattery"
    assert "a.b@example.org" not in rows_of[5].text and rows_of[5].n_chars == len(rows_of[5].text) and rows_of[5].found == "x"
    mixed = cp.mix_sources(spark, made, str(tmp_path))
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in made.collect()} - {1, 2, 6}
    done = cp.encode(spark, docs, str(tmp_path)).collect()
    assert len(done) == 9 and all(r.parity for r in done) and {r.n_tokens for r in done if r.doc_id in (1, 2)} == {0}


def test_stages_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd_documents(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0, name
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_run_cleans_up(spark):
    from skein.sources.shared import recorded

    with recorded() as paths:
        rows_left = cp.run(spark, SF).count()
    there = [p for p in paths if os.path.exists(p.removeprefix("file://"))]
    assert rows_left and [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in there] == ["pipeline-sentencepiece"]
