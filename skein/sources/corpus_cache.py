"""A decoded corpus that is made once and served until its source changes.

The decoded rows lie in the shared folder, under the fingerprint of the source they were made from: the snapshot's number of a
versioned table, or the names, sizes and times of a folder's files. A look at the fingerprint reads no data. As long as
it is the same, searches read the decoded rows alone; when it has changed, the next one decodes the source again and removes the old rows.
``invalidate`` drops them at once, and frees their storage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.lexical import LexicalIndex
from skein.sources.shared import remove, scratch
from skein.sources.versions import VersionedTable


def decode_chunks(chunks: DataFrame, size: int) -> DataFrame:
    """Rows kept, their vector null where it hasn't ``size`` components."""
    return chunks.withColumn("vector", F.when(F.size("vector") == size, F.col("vector")))


def folder_fingerprint(spark: SparkSession, folder: str) -> str:
    """A digest of the names, sizes and modification times of a folder's files."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


class CorpusCache:
    """The decoded rows of ``source`` (a versioned table or a folder of Parquet files), and a lexical index of them.

    ``decode`` makes rows (id, text, ...) of the source's rows.
    """

    def __init__(self, spark: SparkSession, source: VersionedTable | str, decode: Callable[[DataFrame], DataFrame]) -> None:
        self.spark, self.source, self.decode = spark, source, decode
        self.decoded = 0
        self._key: str | None = None
        self._path: str | None = None
        self._index: tuple[str, LexicalIndex] | None = None

    def fingerprint(self) -> str:
        if isinstance(self.source, VersionedTable):
            known = self.source.versions()
            return f"snapshot {known[-1] if known else None}"
        return folder_fingerprint(self.spark, self.source)

    def corpus(self) -> DataFrame:
        """The decoded rows: made anew only if there are none, or the source's fingerprint is another one."""
        key = self.fingerprint()
        if key != self._key:
            rows = self.source.read() if isinstance(self.source, VersionedTable) else self.spark.read.parquet(self.source)
            path = scratch(self.spark, "corpus")
            self.decode(rows).write.parquet(path)
            self.invalidate()
            self._key, self._path = key, path
            self.decoded += 1
        return self.spark.read.parquet(self._path)

    def index(self) -> LexicalIndex:
        """A lexical index of the decoded rows, kept as long as they are."""
        corpus = self.corpus()
        if self._index is None:
            path = scratch(self.spark, "corpus-index")
            self._index = path, LexicalIndex.build(corpus.select("id", "text"), path)
        return self._index[1]

    def paths(self) -> list[str]:
        """What the cache holds in the shared folder."""
        return [p for p in (self._path, self._index and self._index[0]) if p]

    def invalidate(self) -> None:
        """Drop the decoded rows and the index, and their files."""
        remove(self.spark, self.paths())
        self._key = self._path = self._index = None
