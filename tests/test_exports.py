import os

from pyspark.sql import functions as F

from skein.sources import tables

NAMES = ["plain-1", "_hidden-2", ".dot-3", "a/b:c-4", "50%25 +x-5", "line\nend\t-6", "straße é 🤖-7", "2024-01-8", "x.gz", " sp ace ", "{a}[b]*?-9"]


def test_one_file_a_session_whatever_its_name(spark, tmp_path):
    df = spark.createDataFrame([(n, f"{n}\r\nbody 🤖") for n in NAMES] + [("none", None)], "file_name string, body string")
    folder = f"file://{tmp_path}/out"
    for _ in range(2):  # the second export replaces the first
        tables.export_all(df, folder)
        assert {r.file_name: r.value for r in tables.exported(spark, folder).collect()} == {n: f"{n}\r\nbody 🤖\n" for n in NAMES} | {"none": "\n"}
    found = [os.path.join(at, f) for at, _, files in os.walk(f"{tmp_path}/out") for f in files if not f.endswith(".crc")]
    assert len(found) == len(NAMES) + 1 and all(os.path.dirname(f) == f"{tmp_path}/out" for f in found)


def test_repeated_and_missing_names(spark, tmp_path):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), (None, "3"), ("", "4")], "file_name string, body string")
    tables.export_all(df, f"{tmp_path}/out")
    got = {r.file_name: sorted(r.value.split()) for r in tables.exported(spark, f"{tmp_path}/out").collect()}
    assert got == {"a": ["1", "2"], None: ["3", "4"]}


def test_nothing_to_export(spark, tmp_path):
    tables.export_all(spark.createDataFrame([("a", "1")], "file_name string, body string").limit(0), f"{tmp_path}/out")
    assert tables.exported(spark, f"{tmp_path}/out").count() == 0


def _started() -> int:
    """Processes and threads that the machine has started so far."""
    with open("/proc/stat") as f:
        return next(int(line.split()[1]) for line in f if line.startswith("processes"))


def test_sessions_start_no_processes(spark, tmp_path):
    """Where Hadoop has no native library, Spark's writers start processes for each new folder and file."""
    df = spark.range(2000).select(F.format_string("s-%d", "id").alias("file_name"), F.lit("x").alias("body"))
    before = _started()
    tables.export_all(df, f"{tmp_path}/out")
    assert _started() - before < 1500
    assert tables.exported(spark, f"{tmp_path}/out").count() == 2000
