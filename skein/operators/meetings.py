"""Transcripts and reports: speakers, assembly, window plans, summaries, state machines, memory."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import scores, text
from skein.operators.scans import run_machine

WINDOW_TOKENS, SKIP_MAP_TOKENS, LEAST_TOKENS, PARTIALS = 2200, 2150, 15, 7
MAP_OUTPUT = 300
SLACK = 0.05


def label_speakers(segments: DataFrame, spans: DataFrame, bucket: float = 600.0) -> DataFrame:
    """session_id, segment_id, speaker: the speaker of the greatest total overlap, ties to the smaller name; else null.

    Both sides are cut at multiples of ``bucket`` seconds, so that only what lies in the same stretch of a session
    meets, however long the session is; overlaps are summed per speaker before they are ranked.
    """

    def cut(rows: DataFrame) -> DataFrame:
        """Rows in each bucket they touch, clipped to it."""
        reach = F.sequence(F.floor(F.col("start") / bucket), F.greatest(F.floor(F.col("start") / bucket), F.ceil(F.col("end") / bucket) - 1))
        rows = rows.filter(F.col("end") > F.col("start")).withColumn("bucket", F.explode(reach))
        low = F.col("bucket") * F.lit(bucket)
        return rows.withColumn("lo", F.greatest("start", low)).withColumn("hi", F.least("end", low + bucket))

    s, p = cut(segments).alias("s"), cut(spans).alias("p")
    shared = scores.overlap(F.col("s.lo"), F.col("s.hi"), F.col("p.lo"), F.col("p.hi"))
    same = (F.col("s.session_id") == F.col("p.session_id")) & (F.col("s.bucket") == F.col("p.bucket"))
    pairs = s.join(p, same & (F.col("s.lo") < F.col("p.hi")) & (F.col("p.lo") < F.col("s.hi")))
    total = pairs.select("s.session_id", "s.segment_id", "p.speaker", shared.alias("o")).groupBy("session_id", "segment_id", "speaker").agg(F.round(F.sum("o"), 6).alias("o"))
    best = total.filter("o > 0").groupBy("session_id", "segment_id").agg(F.min_by("speaker", F.struct(-F.col("o"), F.col("speaker"))).alias("speaker"))
    return segments.select("session_id", "segment_id").join(best, ["session_id", "segment_id"], "left")


def merge_line(last: tuple | None, new: tuple) -> tuple[str, tuple | None]:
    """What a final update (text, start, end) does to the last line: append, replace (with the new line) or drop."""
    if last is None:
        return "append", new
    overlaps = new[1] < last[2] - SLACK and new[2] > last[1]
    if not overlaps:
        return "append", new
    a, b = last[0].strip().lower(), new[0].strip().lower()
    if a == b:
        return "drop", last
    if a == "" or b.startswith(a):
        return "replace", (new[0], min(last[1], new[1]), max(last[2], new[2]))
    if a.startswith(b):
        return "drop", last
    return "append", new


def assemble(updates: DataFrame) -> DataFrame:
    """session_id, line, text, start, end: exactly-once lines of final updates in arrival order (seq)."""

    def fold(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("seq", "text", "start", "end")), strict=True))
        lines: list[tuple] = []
        for _, *new in rows:
            kind, line = merge_line(lines[-1] if lines else None, tuple(new))
            if kind == "append":
                lines.append(line)
            elif kind == "replace":
                lines[-1] = line
        session = table.column("session_id")[0].as_py()
        return pa.table({
            "session_id": pa.array([session] * len(lines), pa.string()), "line": pa.array(range(len(lines)), pa.int64()),
            "text": pa.array([x[0] for x in lines], pa.string()), "start": pa.array([x[1] for x in lines], pa.float64()),
            "end": pa.array([x[2] for x in lines], pa.float64()),
        })

    finals = updates.filter("is_final").select("session_id", "seq", F.coalesce("text", F.lit("")).alias("text"), "start", "end")
    return finals.groupBy("session_id").applyInArrow(fold, "session_id string, line long, text string, start double, end double")


def tokens_of(value: str) -> int:
    return -(-len(value) * 2 // 7)


def tokens_of_size(size: int) -> int:
    return -(-size * 2 // 7)


def plan_windows(segments: list[list[int]], limit: int = WINDOW_TOKENS) -> list[int]:
    """Sizes in characters of the windows: whole segments, joined by spaces, up to ``limit`` tokens.

    A segment is the list of its sentences' sizes (split at ". "); one of several sentences is larger than a window,
    stands alone and is split between sentences.
    """
    windows: list[int] = []
    size, used, number = 0, 0, 0

    def flush():
        nonlocal size, used, number
        if number:
            windows.append(size)
        size = used = number = 0

    for parts in segments:
        alone = tokens_of_size(sum(parts) + 2 * (len(parts) - 1)) > limit
        gap = 2 if alone else 1
        if alone:
            flush()
        for part in parts if alone else [parts[0]]:
            n = tokens_of_size(part)
            if number and used + n > limit:
                flush()
            size += part + gap * (number > 0)
            used += n
            number += 1
        if alone:
            flush()
    flush()
    return windows


def _segment_sizes(segments: DataFrame, limit: int) -> DataFrame:
    """(session_id, start, sizes): only sizes travel; a segment larger than a window has one for each sentence."""
    body = F.coalesce("text", F.lit(""))
    large = F.ceil(F.length(body) * 2 / 7) > limit
    sizes = F.when(large, F.transform(F.split(body, r"\. ", -1), lambda x: F.length(x))).otherwise(F.array(F.length(body)))
    return segments.select("session_id", "start", sizes.alias("sizes"))


def _session_windows(table: pa.Table, limit: int) -> list[int]:
    rows = sorted(zip(table.column("start").to_pylist(), table.column("sizes").to_pylist(), strict=True), key=lambda r: r[0])
    return plan_windows([sizes for _, sizes in rows], limit)


def summary_calls(windows: list[int]) -> list[tuple[str, int, int]]:
    """(stage, number, tokens) of the model calls that a summary of windows of these sizes takes; nothing for a text that is too short."""
    total = sum(map(tokens_of_size, windows))
    if total < LEAST_TOKENS:
        return []
    if len(windows) == 1 and total <= SKIP_MAP_TOKENS:
        return [("reduce", 0, total)]
    calls = [("map", k, tokens_of_size(w)) for k, w in enumerate(windows)]
    n, level = len(windows), 0
    while n > PARTIALS:
        groups = -(-n // PARTIALS)
        calls += [(f"merge{level}", k, MAP_OUTPUT * min(PARTIALS, n - k * PARTIALS)) for k in range(groups)]
        n, level = groups, level + 1
    return calls + [("reduce", 0, MAP_OUTPUT * n)]


def summary_plan(segments: DataFrame, limit: int = WINDOW_TOKENS) -> DataFrame:
    """session_id, stage, number, tokens of segments (session_id, start, text)."""

    def fold(table: pa.Table) -> pa.Table:
        calls = summary_calls(_session_windows(table, limit))
        session = table.column("session_id")[0].as_py()
        a, b, c = zip(*calls, strict=True) if calls else ((), (), ())
        return pa.table({"session_id": pa.array([session] * len(a), pa.int64()), "stage": pa.array(a, pa.string()), "number": pa.array(b, pa.int64()), "tokens": pa.array(c, pa.int64())})

    return _segment_sizes(segments, limit).groupBy("session_id").applyInArrow(fold, "session_id long, stage string, number long, tokens long")


def window_plan(segments: DataFrame, limit: int = WINDOW_TOKENS) -> DataFrame:
    """session_id, window, tokens, n_chars of segments (session_id, start, text)."""

    def fold(table: pa.Table) -> pa.Table:
        made = _session_windows(table, limit)
        session = table.column("session_id")[0].as_py()
        return pa.table({"session_id": pa.array([session] * len(made), pa.int64()), "window": pa.array(range(len(made)), pa.int64()),
                         "tokens": pa.array(list(map(tokens_of_size, made)), pa.int64()), "n_chars": pa.array(made, pa.int64())})

    return _segment_sizes(segments, limit).groupBy("session_id").applyInArrow(fold, "session_id long, window long, tokens long, n_chars long")


def needs_retry(state: Column, has_summary: Column, available: Column) -> Column:
    """Which reports to run again."""
    return F.when(state == "pending", ~has_summary).when(state == "failed", F.lit(True)).when(state == "unavailable", available).otherwise(F.lit(False))


def next_state(state: Column, generated: Column, available: Column) -> Column:
    """none or retried -> pending -> ready, failed or unavailable."""
    return F.when(~available, F.lit("unavailable")).when(generated, F.lit("ready")).otherwise(F.lit("failed"))


def upkeep(stored: DataFrame, retired: DataFrame, added: DataFrame, keep: int = 60) -> DataFrame:
    """id, kind, text, updated_at of facts after retiring, adding and pruning.

    Retire by normalised text; add with duplicates merged (the stored text and kind stay, the newest date counts);
    unknown kinds become general; the newest ``keep`` facts stay. Equal keys are pre-aggregated before the shuffle.
    """
    key = text.normal_key(F.col("text"))
    left = stored.withColumn("key", key).join(retired.select(key.alias("key")).distinct(), "key", "left_anti")
    both = left.select("key", "id", "kind", "text", "updated_at", F.lit(0).alias("prio")).unionByName(
        added.filter(text.strip(F.col("text")) != "").select(key.alias("key"), "id", "kind", "text", "updated_at", F.lit(1).alias("prio"))
    )
    merged = both.groupBy("key").agg(F.min_by(F.struct("id", "kind", "text"), F.struct("prio", "id")).alias("f"), F.max("updated_at").alias("updated_at"))
    known = F.col("f.kind").isin("person", "project", "decision", "preference", "recurring", "general")
    facts = merged.select("f.id", F.when(known, F.col("f.kind")).otherwise(F.lit("general")).alias("kind"), "f.text", "updated_at")
    return facts.orderBy(F.desc("updated_at"), "id").limit(keep)


#: Commands by event and state, and states after them. Route changes count for added and removed devices.
COMMANDS = {
    ("began", "recording"): "pauseCapture", ("ended_resume", "paused"): "resumeCapture", ("ended", "paused"): "surfacePausedState",
    ("route_changed", "recording"): "reinstallTap", ("reset", "recording"): "rebuildEngine", ("reset", "paused"): "rebuildEngine",
}
STATES = {
    ("start", "idle"): "recording", ("began", "recording"): "paused", ("ended_resume", "paused"): "recording",
    ("stop", "recording"): "idle", ("stop", "paused"): "idle",
}


def command(event: Column, state: Column) -> Column:
    """The command that an audio event gives in a state (idle, recording, paused by an interruption); null for none."""
    out = F.lit(None).cast("string")
    for (e, s), made in COMMANDS.items():
        out = F.when((event == e) & (state == s), F.lit(made)).otherwise(out)
    return out


def run_states(events: DataFrame) -> DataFrame:
    """key, seq, event, state, command: the pause state machine over each key's ordered events, which may span many tasks.

    ``state`` is the one after the event; the command follows from the event and the state before it.
    """
    walked = run_machine(events.select("key", "seq", "event"), "key", ["seq", "event"], "event", ["idle", "recording", "paused"], STATES)
    return walked.select("key", "seq", "event", "state", command(F.col("event"), F.col("before")).alias("command"))


def last_turns(turns: DataFrame, n: int = 6) -> DataFrame:
    """The last ``n`` turns of each conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(order)).filter(F.col("back") <= n).drop("back")
