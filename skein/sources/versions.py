"""Tables with snapshots: commits by rename, copy-on-write of key buckets, batch numbers that make repeats harmless.

A table is a folder. Its rows lie in ``data/<commit>/bucket=<k>``, k being the hash of the key columns modulo the number of
buckets; files there never change. A snapshot is a manifest, ``snapshots/<number>.json``, that names the folders that
make it up. It is written under a temporary name and renamed without overwriting: where the file system's rename is atomic, as in
HDFS, of two commits of one number only one succeeds, and the other is made again on the newer snapshot. Readers open one manifest and see its rows alone, whatever is committed
meanwhile. What a killed job has written is named by no manifest, and ``vacuum`` removes it.

A commit may carry a token (writer, batch): a batch that is not beyond the writer's last one changes nothing, so that a
batch repeated after a failure leaves equal rows. Appends add a folder; replacing, deleting and upserting rewrite only the
buckets of the keys concerned. Rows whose key is null share a bucket. Manifests grow with the folders they name, which ``compact`` joins.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "__bucket"
#: Commits that may come between a writer's look at the table and its own commit before it gives up.
TRIES = 20


@dataclass(frozen=True)
class Snapshot:
    """A manifest: the schema, the folders of each bucket and the last batch of each writer."""

    number: int
    schema: StructType
    folders: dict[int, list[str]] = field(default_factory=dict)
    tokens: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"number": self.number, "schema": self.schema.jsonValue(), "folders": {str(k): v for k, v in self.folders.items()}, "tokens": self.tokens})

    @classmethod
    def parse(cls, text: str) -> Snapshot:
        raw = json.loads(text)
        return cls(raw["number"], StructType.fromJson(raw["schema"]), {int(k): v for k, v in raw["folders"].items()}, raw["tokens"])


class VersionedTable:
    """A table below ``path`` with snapshots, its rows dealt by ``keys`` into ``buckets``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 16) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # Files

    def _file(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._file("").getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        fs, where = self._fs(), self._file(folder)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def versions(self) -> list[int]:
        """Numbers of the snapshots that are kept, oldest first."""
        return sorted(int(n.removesuffix(".json")) for n in self._names("snapshots") if n.endswith(".json") and not n.startswith("."))

    def snapshot(self, number: int | None = None) -> Snapshot | None:
        """A snapshot, by default the newest; none of an empty table."""
        if number is None:
            known = self.versions()
            if not known:
                return None
            number = known[-1]
        stream = self._fs().open(self._file(f"snapshots/{number:020d}.json"))
        try:
            return Snapshot.parse(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, snapshot: Snapshot) -> bool:
        """Whether the snapshot's number was still free."""
        fs, name = self._fs(), f"snapshots/.{snapshot.number:020d}-{uuid.uuid4().hex}"
        stream = fs.create(self._file(name), False)
        try:
            stream.write(bytearray(snapshot.text().encode()))
        finally:
            stream.close()
        last = self._file(f"snapshots/{snapshot.number:020d}.json")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(last.toUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.spark.sparkContext._gateway.new_array(rename, 1)
        kinds[0] = rename.NONE
        try:
            context.rename(fs.makeQualified(self._file(name)), fs.makeQualified(last), kinds)
            return True
        except Exception as failed:
            if not fs.exists(last):
                raise
            if "FileAlreadyExists" not in str(failed):
                raise
            fs.delete(self._file(name), False)
            return False

    # Reading

    def _bucket(self):
        return F.pmod(F.xxhash64(*(F.col(k) for k in self.keys)), F.lit(self.buckets)).cast("int")

    def _rows(self, snapshot: Snapshot, buckets: set[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{f}" for k, held in sorted(snapshot.folders.items()) if buckets is None or k in buckets for f in held]
        if not folders:
            return self.spark.createDataFrame([], snapshot.schema)
        return self.spark.read.schema(snapshot.schema).parquet(*folders)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of one snapshot, by default the newest."""
        found = self.snapshot(number)
        if found is None:
            raise ValueError(f"no snapshot in {self.path}")
        return self._rows(found)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Rows whose keys are among ``wanted``: only the buckets of these are read."""
        found = self.snapshot()
        if found is None:
            raise ValueError(f"no snapshot in {self.path}")
        ids = wanted.select(*self.keys).distinct()
        return self._rows(found, self._touched(ids)).join(ids, self.keys, "left_semi")

    def _touched(self, keys: DataFrame) -> set[int]:
        return {r[0] for r in keys.select(self._bucket()).distinct().collect()}

    # Writing

    def _write(self, rows: DataFrame) -> dict[int, list[str]]:
        """The rows in a folder of their own; its buckets."""
        name = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn(BUCKET, self._bucket())
        dealt.write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        return {int(n.split("=")[1]): [f"{name}/{n}"] for n in self._names(name) if n.startswith(f"{BUCKET}=")}

    def commit(self, make: Callable[[Snapshot | None], tuple[StructType, dict[int, list[str]]] | None], token: tuple[str, int] | None = None) -> int | None:
        """The number of the snapshot that ``make`` leads to from the newest one; none where the token's batch was committed before.

        ``make`` returns the schema and folders of the next snapshot. It is called again where another commit came first.
        """
        for _ in range(TRIES):
            last = self.snapshot()
            tokens = dict(last.tokens) if last else {}
            if token is not None:
                if tokens.get(token[0], -1) >= token[1]:
                    return None
                tokens[token[0]] = token[1]
            made = make(last)
            if made is None:
                return last.number if last else None
            fresh = Snapshot(last.number + 1 if last else 0, made[0], made[1], tokens)
            if self._publish(fresh):
                return fresh.number
        raise RuntimeError(f"{TRIES} other commits came first")

    def append(self, rows: DataFrame, token: tuple[str, int] | None = None) -> int | None:
        """Add rows. They are written once, however often the commit is tried."""
        written: list[dict[int, list[str]]] = []

        def make(last: Snapshot | None):
            if not written:
                written.append(self._write(rows if last is None else rows.select(*last.schema.names)))
            folders = {k: list(v) for k, v in last.folders.items()} if last else {}
            for k, added in written[0].items():
                folders[k] = folders.get(k, []) + added
            return (last.schema if last else rows.schema), folders

        return self.commit(make, token)

    def overwrite(self, rows: DataFrame, token: tuple[str, int] | None = None) -> int | None:
        """These rows and no others: readers see the old ones until the commit."""
        return self.commit(lambda last: (rows.schema, self._write(rows)), token)

    def _rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], schema: StructType, token: tuple[str, int] | None) -> int | None:
        """Copy the buckets of ``keys``, changed; the others stay as they are."""

        def make(last: Snapshot | None):
            held = last or Snapshot(-1, schema)
            touched = self._touched(keys)
            if not touched:
                return held.schema, held.folders
            fresh = self._write(change(self._rows(held, touched)).select(*held.schema.names))
            return held.schema, {k: v for k, v in held.folders.items() if k not in touched} | fresh

        return self.commit(make, token)

    def replace(self, rows: DataFrame, also: DataFrame | None = None, token: tuple[str, int] | None = None) -> int | None:
        """Re-index: the rows of all keys in ``rows`` (and of those in ``also``, which may have no rows any more) give way to ``rows``."""
        keys = rows.select(*self.keys).distinct()
        keys = keys if also is None else keys.union(also.select(*self.keys)).distinct()
        return self._rewrite(keys, lambda held: held.join(keys, self.keys, "left_anti").unionByName(rows), rows.schema, token)

    def delete(self, keys: DataFrame, token: tuple[str, int] | None = None) -> int | None:
        gone = keys.select(*self.keys).distinct()
        last = self.snapshot()
        if last is None:
            return None
        return self._rewrite(gone, lambda held: held.join(gone, self.keys, "left_anti"), last.schema, token)

    def upsert(self, rows: DataFrame, version: str, token: tuple[str, int] | None = None) -> int | None:
        """The latest ``version`` of each key; of equal versions the new row."""

        def latest(held: DataFrame) -> DataFrame:
            both = held.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
            order = Window.partitionBy(*self.keys).orderBy(F.desc(version), F.desc("__new"))
            return both.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n", "__new")

        return self._rewrite(rows, latest, rows.schema, token)

    # Upkeep

    def compact(self) -> int | None:
        """Join the folders of each bucket that has several."""

        def make(last: Snapshot | None):
            many = {k for k, v in last.folders.items() if len(v) > 1} if last else set()
            if not many:
                return None
            return last.schema, {k: v for k, v in last.folders.items() if k not in many} | self._write(self._rows(last, many))

        return self.commit(make)

    def vacuum(self, keep: int = 1, older_than: float = 86400.0) -> list[str]:
        """Forget all but the newest ``keep`` snapshots and remove folders that no kept one names.

        Folders younger than ``older_than`` seconds may belong to a commit under way and stay.
        """
        fs, known = self._fs(), self.versions()
        for number in known[: max(0, len(known) - keep)]:
            fs.delete(self._file(f"snapshots/{number:020d}.json"), False)
        named = {f.split("/")[1] for n in known[-keep:] for held in self.snapshot(n).folders.values() for f in held}
        gone = []
        for status in fs.listStatus(self._file("data")) if fs.exists(self._file("data")) else []:
            name = status.getPath().getName()
            if name not in named and time.time() - status.getModificationTime() / 1000 >= older_than:
                fs.delete(status.getPath(), True)
                gone.append(name)
        return gone


def sink(table: VersionedTable, writer: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch is appended once, even if the query delivers it again."""
    return lambda rows, batch: table.append(rows, (writer, batch)) and None
