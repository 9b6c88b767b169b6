"""Python over Arrow batches in bounded memory."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows of a batch that travels to Python: whole texts are long, so batches are small.
BATCH_ROWS = 1024


def _release() -> None:
    """Give memory that a task no longer needs back to the system: Python workers live on from stage to stage."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    gc.freeze()  # what is left are modules, which later collections need not look at
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow with small batches, whose workers release their memory when a partition ends."""
    conf = df.sparkSession.conf
    now = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def bounded(batches):
        seen = False

        def watched():
            nonlocal seen
            for batch in batches:
                seen = True
                yield batch

        try:
            yield from run(watched())
        finally:
            if seen:
                _release()

    return df.mapInArrow(bounded, schema)
