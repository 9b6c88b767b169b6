"""Streaming transcripts: volatile and final updates, running text, incremental sentences, pauses, two sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.operators.sentences import completed

UPDATES = "session_id string, seq long, ts timestamp, text string, is_final boolean, start double, end double"


def read_updates(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of update files (JSON lines)."""
    return spark.readStream.schema(UPDATES).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def finals(updates: DataFrame) -> DataFrame:
    return updates.filter("is_final")


def latest_volatile(updates: DataFrame) -> DataFrame:
    """The newest volatile text of each session that no later final has superseded."""
    last = updates.groupBy("session_id").agg(F.max_by(F.struct("is_final", "text"), "seq").alias("u"), F.max("seq").alias("seq"))
    return last.filter("not u.is_final").select("session_id", "seq", F.col("u.text").alias("text"))


def running_text(updates: DataFrame) -> DataFrame:
    """session_id, seq, combined: all finals so far and the current volatile text, by one fold over a session's updates."""

    def fold(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("seq", "is_final", "text")), strict=True), key=lambda r: r[0])
        said, combined = "", []
        for _, final, text in rows:
            if final and text is not None:
                said = f"{said} {text}" if said else text
            combined.append(said.strip(" ") if final else None if text is None else f"{said} {text}".strip(" "))
        sessions = table.column("session_id").combine_chunks()[0].as_py()
        return pa.table({"session_id": pa.array([sessions] * len(rows), pa.string()), "seq": pa.array([r[0] for r in rows], pa.int64()), "combined": pa.array(combined, pa.string())})

    return updates.select("session_id", F.col("seq").cast("long"), "is_final", "text").groupBy("session_id").applyInArrow(fold, "session_id string, seq long, combined string")


def sentence_stream(snapshots: DataFrame) -> DataFrame:
    """session_id, sentence of cumulative snapshots (session_id, seq, text): each sentence once, when it is complete."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else 0
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            found, at = completed(r.text, min(at, len(r.text)))
            out += found
        state.update((at,))
        yield pd.DataFrame({"session_id": [key[0]] * len(out), "sentence": out})

    return snapshots.groupBy("session_id").applyInPandasWithState(step, "session_id string, sentence string", "at long", "update", GroupStateTimeout.NoTimeout)


def pauses(events: DataFrame, key: str, ts: str, hold_seconds: float) -> DataFrame:
    """Ends of bursts: events after which nothing came for ``hold_seconds`` (the last of each key included)."""
    following = F.lead(ts).over(Window.partitionBy(key).orderBy(ts))
    gap = (F.unix_micros(following) - F.unix_micros(ts)) / F.lit(1e6)
    return events.withColumn("gap", gap).filter(F.col("gap").isNull() | (F.col("gap") >= hold_seconds - 1e-6))


def tee(stream: DataFrame, first: Callable[[DataFrame, int], None], second: Callable[[DataFrame, int], None], marks: str):
    """A query that gives each batch to two sinks, the side effect ``first``; the batch is computed once."""

    def both(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            first(rows, batch)
            second(rows, batch)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", marks).trigger(availableNow=True).start()
