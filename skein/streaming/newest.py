"""A streaming source that keeps up by dropping: of what has come since the last batch, the newest rows are kept.

The source is a folder of Parquet files that is only added to, files in order of their names. Offsets count rows, so that a range of offsets names the
same rows whenever it is read again. The driver reads file footers only; rows are read by the tasks. Each row carries ``dropped``, how many rows
were passed over just before its batch's first row.

    spark.dataSource.register(NewestRows)
    spark.readStream.format("newest_rows").schema("id long, text string").option("capacity", 64).load(folder)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

#: Rows that are kept of a batch.
CAPACITY = 64


@dataclass
class Slice(InputPartition):
    """Rows ``skip`` to ``skip + take`` of a file, and what was dropped before the batch."""

    file: str
    skip: int
    take: int
    dropped: int


class NewestReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, path: str, capacity: int) -> None:
        self.schema, self.path, self.capacity = schema, path, capacity
        self.known: list[tuple[str, int]] = []  # files and their rows, in order

    def _filesystem(self) -> tuple[pafs.FileSystem, str]:
        uri = self.path if "://" in self.path else "file://" + self.path
        return pafs.FileSystem.from_uri(uri)

    def _look(self) -> list[tuple[str, int]]:
        """All files with their rows; footers of new ones are read."""
        system, folder = self._filesystem()
        found = sorted(f.path for f in system.get_file_info(pafs.FileSelector(folder)) if f.base_name.endswith(".parquet") and not f.base_name.startswith((".", "_")))
        names = [name for name, _ in self.known]
        if found[: len(names)] != names:
            raise ValueError(f"files of {self.path} must be added in order of their names, and stay")
        self.known += [(name, pq.read_metadata(name, filesystem=system).num_rows) for name in found[len(names) :]]
        return self.known

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        return {"rows": sum(n for _, n in self._look())}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        if not self.known:
            self._look()
        lo, hi = max(start["rows"], end["rows"] - self.capacity), end["rows"]
        out, at = [], 0
        for name, n in self.known:
            first, last = max(lo, at), min(hi, at + n)
            if first < last:
                out.append(Slice(name, first - at, last - first, lo - start["rows"]))
            at += n
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        system, _ = self._filesystem()
        target = to_arrow_schema(self.schema)
        columns = [f.name for f in target if f.name != "dropped"]
        skip, take = partition.skip, partition.take
        with pq.ParquetFile(partition.file, filesystem=system) as held:
            groups, at = [], 0
            for g in range(held.num_row_groups):
                n = held.metadata.row_group(g).num_rows
                if at < skip + take and at + n > skip:
                    groups.append((g, at))
                at += n
            for g, at in groups:
                rows = held.read_row_group(g, columns=columns)
                first, last = max(skip, at) - at, min(skip + take, at + rows.num_rows) - at
                rows = rows.slice(first, last - first)
                rows = rows.append_column("dropped", pa.array([partition.dropped] * rows.num_rows, pa.int64()))
                yield from rows.select(target.names).cast(target).combine_chunks().to_batches()

    def commit(self, end: dict) -> None:
        """Nothing is held for what has been read."""


class NewestRows(DataSource):
    """Options: path, capacity. The schema is that of the files; ``dropped`` is added."""

    @classmethod
    def name(cls) -> str:
        return "newest_rows"

    def schema(self) -> str:
        raise ValueError("give the files' schema, and a column dropped long")

    def streamReader(self, schema: StructType) -> NewestReader:
        if "dropped" not in schema.names:
            raise ValueError("the schema needs a column dropped long")
        if schema["dropped"].dataType != LongType():
            raise ValueError("dropped must be long")
        return NewestReader(schema, self.options["path"], int(self.options.get("capacity", CAPACITY)))
