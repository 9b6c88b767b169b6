r"""Cheapest repair of conversations' turns, by a min-plus matrix scan.

A conversation is its rows by turn (nulls first; rows of one turn by role, then text, so that equal rows are neighbours).
Null roles and texts count as one space. A row's initial is its role's first character. Each row's first fault counts:

* blank: no character but ASCII white space;
* duplicate: its role and text were seen earlier in the conversation;
* truncated: its last character that isn't ASCII white space is none of ``.!?``.

A repair edits rows until their initials spell ``(s?(ua)+)?``: Keep costs 0, Rerole to user or assistant 3, Delete 4
(required for blank and duplicate rows), Insert an empty user or assistant row anywhere 3; an undeleted truncated row
adds 3. The audit has the edits' initials in order; of the cheapest repairs the one with the ASCII-least audit is made.

Four states suffice: nothing yet, after system, after user, after assistant. A row is a 4 x 4 matrix of (cost, audit)
elements, its edits followed by the closure of insertions; the product takes the least of sums (costs added, audits
joined). Audits of equal cost over the same rows are never prefixes of each other, so the product is associative, and
so are the counts that travel with it. Rows are put in one order by a range partitioning, which may cut a conversation
anywhere; pieces of up to 512 rows are multiplied in their tasks, pieces of longer conversations in a tree of rounds.
The audit is cut at the pieces' borders again, and each piece makes its repaired rows by itself. So a conversation of any
length is spread over tasks; what one task sees of it whole are its audit, its pieces' counts and, for a digest, its rows as a
stream (SHA-256 has no parallel form), never all its texts at once.

Null conversation ids are one conversation. Repeated rows are duplicates. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from skein.llm.common import map_batches, read, stored

#: Rows of a piece (a power of two) and pieces multiplied in one step of the tree.
PIECE, FAN = 512, 64
START, SYSTEM, USER, ASSISTANT = range(4)
SPACE = " \t\n\x0b\x0c\r"
Element = tuple[int, str]
Matrix = list[list[Element | None]]


def _next(state: int) -> int:
    """Where a user or assistant row leads that is made to fit."""
    return ASSISTANT if state == USER else USER


def _least(steps: Iterable[tuple[int, int, int, str]]) -> Matrix:
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i, j, cost, audit in steps:
        if out[i][j] is None or (cost, audit) < out[i][j]:
            out[i][j] = (cost, audit)
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for j in range(4):
            both = [(a[i][k][0] + b[k][j][0], a[i][k][1] + b[k][j][1]) for k in range(4) if a[i][k] and b[k][j]]
            out[i][j] = min(both) if both else None
    return out


#: Any number of insertions: more than two in a row come back to a state already reached.
CLOSURE = _least(step for i in range(4) for step in [(i, i, 0, ""), (i, _next(i), 3, "I"), (i, _next(_next(i)), 6, "II")])


def _edits(code: str) -> Matrix:
    """A row's edits and the insertions behind it. Codes: d for rows to delete; else s, u, a or x (another initial), upper case if
    truncated. A kept system row is J here, so that the audit alone tells the states; it stands between I and K like K itself."""
    steps = []
    for i in range(4):
        steps.append((i, i, 4, "D"))
        if code != "d":
            more, initial = 3 * code.isupper(), code.lower()
            if initial == "s" and i == START:
                steps.append((i, SYSTEM, more, "J"))
            if initial == ("a" if i == USER else "u"):
                steps.append((i, _next(i), more, "K"))
            steps.append((i, _next(i), 3 + more, "R"))
    return product(_least(steps), CLOSURE)


EDITS = {code: _edits(code) for code in "dsuaxSUAX"}
_KNOWN: dict[str, Matrix] = {}


def matrix(codes: str) -> Matrix:
    """The product over a piece's rows; those of short pieces are remembered."""
    if codes not in _KNOWN:
        made = reduce(product, (EDITS[c] for c in codes))
        if len(codes) > 12:
            return made
        if len(_KNOWN) >= 1 << 14:
            _KNOWN.clear()
        _KNOWN[codes] = made
    return _KNOWN[codes]


def folded(rows: DataFrame, keys: list[str], order: list[str], group: Callable[[dict], object], schema: str | StructType) -> DataFrame:
    """Feed each group's rows, in order, to an object that ``group`` makes from the first of them.

    The object's ``add(row)`` and ``end()`` return rows of ``schema``. A task sees its rows one after the other.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if held is None or key != last:
                    out += held.end() if held is not None else ()
                    last, held = key, group(row)
                out += held.add(row)
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out = []
        out += held.end() if held is not None else ()
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return map_batches(rows.repartition(*(F.col(k) for k in keys)).sortWithinPartitions(*keys, *order), run, schema)


def _same(a: DataFrame, b: DataFrame, how: str, *more: str) -> DataFrame:
    """Join on conv_id, where null equals null, and further columns; ``b``'s keys go."""
    keys = ["conv_id", *more]
    b = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[f"_{k}"]) for k in keys))
    return a.join(b, on, how).drop(*(f"_{k}" for k in keys))


def ordered(turns: DataFrame) -> DataFrame:
    """The rows with ``at``, a number that follows conversations and the order inside them, and ``piece``; written to the shared folder."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    # Texts are long: their beginnings decide the partition, the rest only the order inside it.
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64)]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    return stored(rows.withColumn("piece", F.shiftright("at", PIECE.bit_length() - 1)), "turns")


def _faults(rows: DataFrame) -> DataFrame:
    """conv_id, piece, at, turn, initial, fault (blank, duplicate, truncated or null) of ``ordered`` rows, without their texts."""
    kept = F.rtrim("text", F.lit(SPACE))
    slim = rows.select(
        "conv_id", "piece", "at", "turn", F.substring("role", 1, 1).alias("initial"), (kept == "").alias("blank"), (~F.substring(kept, -1, 1).isin(".", "!", "?")).alias("open"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said"),
    )
    slim = stored(slim, "turn-digests")
    again = slim.groupBy("conv_id", "said").agg(F.min("at").alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    fault = F.when(F.col("blank"), "blank").when(F.col("first") < F.col("at"), "duplicate").when(F.col("open"), "truncated")
    return _same(slim, again, "left", "said").select("conv_id", "piece", "at", "turn", "initial", fault.alias("fault"))


COUNTS = ("n", "turns", "blank", "duplicate", "truncated", "illegal")
ELEMENT = "n long, turns long, blank long, duplicate long, truncated long, illegal long, lo long, hi long, first string, last string, costs array<int>, audits array<string>"


class _Piece:
    """Rows of a piece become an element: counts, borders and a matrix."""

    def __init__(self, row: dict) -> None:
        self.out = dict.fromkeys(COUNTS, 0) | {"conv_id": row["conv_id"], "piece": row["piece"], "lo": None, "hi": None, "last": None, "first": row["initial"]}
        self.codes: list[str] = []

    def add(self, row: dict) -> tuple:
        o, fault, initial = self.out, row["fault"], row["initial"]
        if row["turn"] is not None:
            o["turns"] += row["turn"] != o["hi"]
            o["lo"] = row["turn"] if o["lo"] is None else o["lo"]
            o["hi"] = row["turn"]
        if fault:
            o[fault] += 1
        o["illegal"] += o["n"] > 0 and o["last"] + initial not in ("su", "ua", "au")
        o["n"] += 1
        o["last"] = initial
        code = initial if initial and initial in "sua" else "x"
        self.codes.append("d" if fault in ("blank", "duplicate") else code.upper() if fault else code)
        return ()

    def end(self) -> list[dict]:
        m = [e for row in matrix("".join(self.codes)) for e in row]
        return [self.out | {"costs": [e and e[0] for e in m], "audits": [e and e[1] for e in m]}]


def _matrix_of(row: dict) -> Matrix:
    flat = [None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"], strict=True)]
    return [flat[k : k + 4] for k in range(0, 16, 4)]


def joined(a: dict, b: dict) -> dict:
    """The element of two neighbouring stretches of rows."""
    out = {c: a[c] + b[c] for c in COUNTS}
    # Rows stand by turn: only the turn at the border can be in both.
    out["turns"] -= a["hi"] is not None and a["hi"] == b["lo"]
    out["illegal"] += a["last"] + b["first"] not in ("su", "ua", "au")
    m = [e for row in product(_matrix_of(a), _matrix_of(b)) for e in row]
    return a | out | {
        "lo": b["lo"] if a["lo"] is None else a["lo"], "hi": a["hi"] if b["hi"] is None else b["hi"], "last": b["last"],
        "costs": [e and e[0] for e in m], "audits": [e and e[1] for e in m],
    }


class _Stretch:
    """Neighbouring elements become one; those of equal depth are joined first, so that audits are copied few times."""

    def __init__(self, row: dict) -> None:
        self.held: list[tuple[int, dict]] = []

    def add(self, row: dict) -> tuple:
        depth = 0
        while self.held and self.held[-1][0] == depth:
            row, depth = joined(self.held.pop()[1], row), depth + 1
        self.held.append((depth, row))
        return ()

    def end(self) -> list[dict]:
        return [reduce(lambda b, a: joined(a, b), (e for _, e in reversed(self.held))) | {"place": self.held[0][1]["block"]}]


def _scanned(faults: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One element a conversation; and each piece's row count and place in its conversation."""
    kind = faults.schema["conv_id"].dataType.simpleString()
    pieces = stored(folded(faults, ["conv_id", "piece"], ["at"], _Piece, f"conv_id {kind}, piece long, {ELEMENT}"), "turn-pieces")
    counts = pieces.select("conv_id", "piece", "n")
    sizes = counts.groupBy("conv_id").agg(F.count("*").alias("pieces"))
    many = stored(sizes.filter("pieces > 1").select("conv_id"), "turn-many")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("piece")) - 1
    places = _same(counts, many, "left_semi").withColumn("place", place.cast("long"))
    left = _same(pieces, places.select("conv_id", "piece", "place"), "inner", "piece").drop("piece")
    done = _same(pieces, many, "left_anti").drop("piece")
    while True:
        left = left.withColumn("block", F.floor(F.col("place") / FAN))
        left = stored(folded(left, ["conv_id", "block"], ["place"], _Stretch, f"conv_id {kind}, place long, {ELEMENT}"), "turn-stretches")
        if left.filter("place > 0").limit(1).count() == 0:
            return done.unionByName(left.drop("place")), counts


def _finished(costs: list, audits: list) -> Element:
    """The cheapest repair from the start to a proper end."""
    m = product(CLOSURE, _matrix_of({"costs": costs, "audits": audits}))
    return min(m[START][j] for j in (START, ASSISTANT) if m[START][j])


class _Cut:
    """An audit, then its conversation's pieces: each gets the part of its rows, and the state before it."""

    def __init__(self, row: dict) -> None:
        self.audit, self.at, self.state, self.last = row["audit"], 0, START, None

    def _take(self, n: int | None) -> str:
        lo, left = self.at, n
        while self.at < len(self.audit) and left != 0:
            left = left if left is None else left - (self.audit[self.at] != "I")
            self.at += 1
        return self.audit[lo : self.at]

    def add(self, row: dict) -> list[dict]:
        if row["piece"] is None:
            return []
        out = [self.last] if self.last else []
        part = self._take(row["n"])
        self.last = {"conv_id": row["conv_id"], "piece": row["piece"], "part": part, "state": self.state}
        for edit in part:
            self.state = state_after(self.state, edit)
        return out

    def end(self) -> list[dict]:
        if not self.last:
            return []
        self.last["part"] += self._take(None)  # insertions behind the last row
        return [self.last]


def state_after(state: int, edit: str) -> int:
    return state if edit == "D" else SYSTEM if edit == "J" else _next(state)


class _Edited:
    """A piece's rows with its part of the audit become repaired rows; deleted ones are gone."""

    def __init__(self, row: dict) -> None:
        self.part, self.state, self.at = row["part"], row["state"], 0

    def _row(self, row: dict, edit: str, role: str, text: str) -> dict:
        self.state = state_after(self.state, edit)
        return {"conv_id": row["conv_id"], "at": row["at"], "sub": self.at, "role": role, "text": text, "edit": "K" if edit == "J" else edit}

    def _inserted(self, row: dict) -> Iterator[dict]:
        while self.at < len(self.part) and self.part[self.at] == "I":
            yield self._row(row, "I", "assistant" if self.state == USER else "user", "")
            self.at += 1

    def add(self, row: dict) -> list[dict]:
        out = list(self._inserted(row))
        edit = self.part[self.at]
        if edit != "D":
            role = ("assistant" if self.state == USER else "user") if edit == "R" else row["role"]
            out.append(self._row(row, edit, role, row["text"]))
        self.at += 1
        self.row = row
        return out

    def end(self) -> list[dict]:
        return list(self._inserted(self.row))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two frames for rows conv_id, turn, role, text.

    The report has for each conversation: n, gaps, blank, duplicate, truncated, illegal (neighbouring initials other than su, ua,
    au), cost and audit. The repaired rows are conv_id, at and sub (their order), role, text, edit (K, R or I).
    """
    rows = ordered(turns)
    kind = rows.schema["conv_id"].dataType.simpleString()
    elements, counts = _scanned(_faults(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [_finished(c.as_py(), a.as_py()) for c, a in zip(batch.column(8), batch.column(9), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:8], pa.array([c for c, _ in best], pa.int64()), pa.array([a for _, a in best], pa.string())], [*batch.schema.names[:8], "cost", "audit"]
            )

    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps")
    slim = elements.select("conv_id", "n", gaps, "blank", "duplicate", "truncated", "illegal", F.lit(0).cast("long").alias("zero"), "costs", "audits")
    report = map_batches(slim, run, f"conv_id {kind}, n long, gaps long, blank long, duplicate long, truncated long, illegal long, zero long, cost long, audit string")
    report = stored(report.drop("zero"), "turn-report")

    heads = report.select("conv_id", F.lit(None).cast("long").alias("piece"), F.lit(0).cast("long").alias("n"), "audit")
    parts = folded(heads.union(counts.withColumn("audit", F.lit(None).cast("string"))), ["conv_id"], ["piece"], _Cut, f"conv_id {kind}, piece long, part string, state int")
    edited = _same(rows.select("conv_id", "piece", "at", "role", "text"), parts, "inner", "piece")
    repaired = folded(edited, ["conv_id", "piece"], ["at"], _Edited, f"conv_id {kind}, at long, sub long, role string, text string, edit string")
    return report.withColumn("audit", F.translate("audit", "J", "K")), repaired


class _Digest:
    def __init__(self, row: dict) -> None:
        self.id, self.sha, self.n = row["conv_id"], hashlib.sha256(), 0

    def add(self, row: dict) -> tuple:
        line = f"{row['role']}:{row['text']}"
        self.sha.update(("\n" * (self.n > 0) + line).encode("utf-8", "surrogatepass"))
        self.n += 1
        return ()

    def end(self) -> list[dict]:
        return [{"conv_id": self.id, "repaired_sha256": self.sha.hexdigest()}]


def damaged(turns: DataFrame) -> DataFrame:
    """The rows by f = crc32("conv_id:turn") % 20: 0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the
    user's. Nulls are one space, in that key as in roles and texts."""
    space = F.lit(" ")
    text = lambda c: F.coalesce(F.col(c).cast("string"), space)
    f = (F.crc32(F.concat_ws(":", text("conv_id"), text("turn"))) % 20).alias("f")
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), f).filter("f <> 0")
    role = F.when(F.col("f") == 4, "user").otherwise(F.col("role")).alias("role")
    said = F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text")
    return rows.select("conv_id", "turn", role, said, F.explode(F.array_repeat(F.lit(0), F.when(F.col("f") == 3, 2).otherwise(1)))).drop("col")


def _or(name: str, other: object) -> Column:
    return F.coalesce(name, F.lit(other)).alias(name)


def op12_turn_repair(spark, sf_dir):
    """Every conversation of the damaged table: its faults, the cheapest repair's cost and audit, and the repaired rows' digest."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report, repaired = repair(damaged(turns))
    kind = turns.schema["conv_id"].dataType.simpleString()
    digests = folded(repaired, ["conv_id"], ["at", "sub"], _Digest, f"conv_id {kind}, repaired_sha256 string")
    rows = _same(_same(turns.select("conv_id").distinct(), report.drop("n"), "left"), digests, "left")
    counts = [_or(c, 0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *counts, _or("audit", ""), _or("repaired_sha256", hashlib.sha256().hexdigest()))
