import pytest
from pyspark.sql import functions as F

from skein.operators import chunk_udtf, sentences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    chunk_udtf.register(spark)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.array(F.lit(0), F.lit(1000), F.lit(5000)).alias("page_breaks"))
    docs.createOrReplaceTempView("udtf_docs")
    assert rows(spark.sql("SELECT * FROM chunk_text(TABLE(udtf_docs))")) == rows(sentences.chunk_documents(docs))


def test_sessions(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select(F.col("conv_id").alias("session_id"), F.col("turn").cast("double").alias("start"), "text")
    turns.repartition(5).createOrReplaceTempView("udtf_turns")
    made = spark.sql("SELECT * FROM chunk_text(TABLE(udtf_turns) PARTITION BY session_id ORDER BY start)")
    assert rows(made.select("session_id", "chunk_index", "text", "words", "timestamp")) == rows(sentences.chunk_sessions(turns))


def test_odd_arguments(spark):
    spark.createDataFrame([("a", None), ("b", " "), ("c", "One. Two.")], "id string, text string").createOrReplaceTempView("udtf_odd")
    assert rows(spark.sql("SELECT * FROM chunk_text(TABLE(udtf_odd))")) == [("c", 0, "One. Two.", 2, 1)]
    spark.range(1).createOrReplaceTempView("udtf_bare")
    for asked, message in (("TABLE(udtf_bare)", "documents"), ("'x'", "table argument")):
        with pytest.raises(Exception, match=message):
            spark.sql(f"SELECT * FROM chunk_text({asked})").collect()


def test_query_equals_the_frame_form(spark):
    from skein.plans import registry

    found = registry.queries()
    assert rows(found["ext_2_chunk_udtf"](spark, SF)) == rows(found["ir_9_chunk_sessions"](spark, SF).select("session_id", "chunk_index", "words", "timestamp", "text_md5"))
