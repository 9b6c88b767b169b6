import random

import pytest
from pyspark.sql import functions as F

from skein.operators import predicates, substrings
from skein.operators.substrings import SubstringIndex, fold

TEXTS = [
    "The Thing we said", "ÉTUDE sur la thérapie", "straße und STRASSE", "smørrebrød", "soft­hyphen", "ﬁne print", "ＷＩＤＥ letters", "naïve café", "zero​width", "über alles",
    "null\x00byte", "٣ apples 3", "", None, "aa", "ab", "Привет мир", "日本語 text", "ŁÓDŹ", "cœur", "œuvre", "İstanbul ıssız", "a.b.c", "It’s", "100%", "æther", "K2 K²", "θing", "cómbined", "tab\there",
]
QUERIES = ["thing", "THING ", "etude", "strasse", "smorre", "softhyphen", "fine", "wide", "cafe", "zerowidth", "uber", "nullbyte", "3 apples", "a", "ab", "привет", "日本", "lodz", "coeur", "œuv", "istanbul", "b.c", "It’s", "100%", "aether", "k2", "comb", "there", "xyzzy", "", "  "]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    rows += [(k, " ".join(rng.choice([w for w in TEXTS if w]) for _ in range(6))) for k in range(100, 400)]
    rows += [(k, "".join(rng.choice("abcdé ") for _ in range(30))) for k in range(400, 3000)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(5).cache()
    return df, SubstringIndex.build(df)


def test_equal_to_a_scan(table):
    df, index = table
    for query in QUERIES:
        want = df if not query.strip() else df.filter(predicates.matches(F.col("text"), query.strip()))
        assert sorted(r.id for r in index.search(query).collect()) == sorted(r.id for r in want.collect()), query


def test_reads_shrink(spark, table):
    df, index = table
    assert index.candidates("ab") is None and index.candidates("é") is None
    n = index.candidates("xyzzy").count()
    assert n < index.candidates("abc").count() < df.count()
    plan = index.search("strasse")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__shard" in plan or "__shard#" in plan.split("PartitionFilters")[1][:200]
    # A word of one block: only that block's shard and rows are read.
    rows = spark.range(20_000).select("id", F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" end")).alias("text")).repartition(8)
    index = SubstringIndex.build(rows)
    found = index.search("rd 12345 e")
    assert [r.id for r in found.collect()] == [12345]
    files = index.search("12345").inputFiles()
    every = spark.read.parquet(f"{index.path}/rows").inputFiles()
    assert len([f for f in files if "/rows/" in f]) <= len(every)


def test_fold():
    assert fold("Éa") == ("ea", False) and fold("ß") == ("ss", False) and fold("ø")[1] and fold("a­b")[1] and fold("\x01")[1]
    assert substrings.trigrams("abcabc").shape == (3,) and len(substrings.trigrams("a bc d")) == 0


def test_sessions_by_index(spark):
    sessions = spark.createDataFrame([(1, "A Thing", 5), (2, "none", 6), (3, "none", 7)], "session_id long, title string, created long")
    segments = spark.createDataFrame([(2, "some thíngs"), (3, "else"), (2, "things")], "session_id long, text string")
    index = SubstringIndex.build(segments)
    for query in ("thing", "", "else", "zz"):
        assert [r.session_id for r in predicates.search_sessions(sessions, segments, query, index).collect()] == [r.session_id for r in predicates.search_sessions(sessions, segments, query).collect()]


def test_empty(spark):
    index = SubstringIndex.build(spark.createDataFrame([], "id long, text string"))
    assert index.search("thing").count() == 0 and index.search("").count() == 0
