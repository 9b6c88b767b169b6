"""Stateful processors on RocksDB: exactly-once assembly of lines, and ends of turns by timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from skein.operators.meetings import merge_line

LINES = "session_id string, line long, text string, start double, end double"
ENDED = "session_id string, ended_ms long, text string"
HOLD_MS = 800
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Typed state needs the RocksDB store; a checkpoint keeps the store that it began with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class LineAssembler(StatefulProcessor):
    """State of a session: the last seq that was seen and its last line (number, text, start, end), read and written once a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, line long, text string, start double, end double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.last.get()
        seen, number, *line = (None, -1) if held is None else held
        line = line or None
        before = seen
        changed: dict[int, tuple] = {}
        for r in sorted((r for r in rows if r.is_final and (seen is None or r.seq > seen)), key=lambda r: r.seq):
            if seen is not None and r.seq <= seen:
                continue  # delivered twice in this batch
            seen = r.seq
            kind, line = merge_line(line and tuple(line), (r.text or "", r.start, r.end))
            number += kind == "append"
            if kind != "drop":
                changed[number] = line
        if seen != before:
            self.last.update((seen, number, *line))
        for n, (text, start, end) in changed.items():
            yield Row(session_id=key[0], line=n, text=text, start=start, end=end)

    def close(self) -> None:
        pass


def assemble_stream(updates: DataFrame) -> DataFrame:
    """Changed lines of each session: rows (session_id, line, ...) supersede earlier rows of the same line.

    Updates count in order of seq, without a watermark. Updates that come again or late (their seq is not beyond the state's) are refused,
    so that delivery may repeat. Updates without a seq have no place and are refused too.
    """
    use_rocksdb(updates.sparkSession)
    rows = updates.filter("seq is not null").select("session_id", "seq", "is_final", "text", "start", "end")
    return rows.groupBy("session_id").transformWithState(LineAssembler(), LINES, "update", "none")


class TurnEndpointer(StatefulProcessor):
    """State of a session: the newest partial text, when it last changed, and whether its turn has ended."""

    def __init__(self, hold_ms: int = HOLD_MS) -> None:
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "text string, changed_ms long, ended boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        text, changed, ended = self.turn.get() if self.turn.exists() else ("", None, False)
        for r in sorted(rows, key=lambda r: r.ms):
            said = (r.text or "").strip()
            if said == text or (changed is not None and r.ms < changed):
                continue
            if changed is not None and text and not ended and r.ms - changed >= self.hold_ms:
                # The pause was over before this change, inside one batch.
                yield self._end(key, text, changed)
            text, changed, ended = said, r.ms, False
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if changed is not None:
            self.turn.update((text, changed, ended))
            if text and not ended:
                self.handle.registerTimer(changed + self.hold_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.turn.exists():
            return
        text, changed, ended = self.turn.get()
        if text and not ended and changed + self.hold_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.turn.update((text, changed, True))
            yield self._end(key, text, changed)

    def _end(self, key, text: str, changed: int) -> Row:
        return Row(session_id=key[0], ended_ms=changed + self.hold_ms, text=text)

    def close(self) -> None:
        pass


def turn_ends(partials: DataFrame, hold_ms: int = HOLD_MS, delay: str = "0 seconds") -> DataFrame:
    """Turns of live partial texts (session_id, ts, text) that have ended: speech was heard, and then nothing changed for ``hold_ms``.

    The clock is the stream's event time: a turn ends once the watermark, ``delay`` behind the newest ts, passes the pause. A change resets the
    pause; the same text again doesn't. Each pause fires once, silence never. After an end, the next change begins a new turn.
    """
    use_rocksdb(partials.sparkSession)
    rows = partials.withWatermark("ts", delay).select("session_id", "ts", F.unix_millis("ts").alias("ms"), "text")
    ended = rows.groupBy("session_id").transformWithState(TurnEndpointer(hold_ms), ENDED, "append", "eventTime")
    return ended.select("session_id", F.timestamp_millis("ended_ms").alias("ended_at"), "text")
