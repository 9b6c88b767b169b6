"""Tables written to the folder that the cluster shares, to cut a plan's lineage or to use a result several times."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_THREAD = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where none is set, a temporary one, but only for a local master."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for seen in getattr(_THREAD, "recorders", ()):
        seen.append(path)
    return path


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that this thread takes in the shared folder meanwhile."""
    _THREAD.recorders = [*getattr(_THREAD, "recorders", ()), []]
    try:
        yield _THREAD.recorders[-1]
    finally:
        _THREAD.recorders = _THREAD.recorders[:-1]


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables of the shared folder, once nothing reads them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def make_dir(spark: SparkSession, path: str) -> None:
    """A folder at ``path``, if there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)


def file_system(uri: str):
    """pyarrow file system and path of a URI or local path, for tasks that write files of their own."""
    from pyarrow import fs

    if re.match(r"[a-z][a-z0-9+.-]*:/", uri, re.I):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return fs.LocalFileSystem(), uri


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
