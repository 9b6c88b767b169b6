"""Ordered scans over keys of any length: rows are put in one order, cut into pieces, and pieces are composed.

A key's rows may span many tasks. What a piece does to the state before it is a function of the few states there are; functions compose
associatively, so that each piece's function is found by itself, a key's pieces (one short row each) give every piece the state it
begins in, and each piece then walks its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from skein.sources.shared import stored

#: Rows of a piece: a power of two.
PIECE = 4096


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows with ``at``, which follows keys and the order inside them, and ``piece``; written to the shared folder."""
    by = [F.col(c).asc_nulls_first() for c in (key, *order)]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    return stored(dealt.withColumn("piece", F.shiftright("at", PIECE.bit_length() - 1)), "numbered")


def following(rows: DataFrame, key: str, column: str, alias: str) -> DataFrame:
    """``numbered`` rows with the value that ``column`` has in the key's next row: windows span a piece, or one row of each piece."""
    heads = rows.groupBy(F.col(key).alias("__key"), F.col("piece").alias("__piece")).agg(F.min_by(column, "at").alias("head"))
    heads = heads.withColumn("after", F.lead("head").over(Window.partitionBy("__key").orderBy("__piece"))).drop("head")
    inside = F.lead(F.struct(F.col(column).alias("v"))).over(Window.partitionBy(key, "piece").orderBy("at"))
    joined = rows.withColumn("__inside", inside).join(heads, F.col(key).eqNullSafe(F.col("__key")) & (F.col("piece") == F.col("__piece")), "left")
    value: Column = F.when(F.col("__inside").isNotNull(), F.col("__inside.v")).otherwise(F.col("after"))
    return joined.withColumn(alias, value).drop("__key", "__piece", "__inside", "after")


def run_machine(rows: DataFrame, key: str, order: list[str], event: str, states: list[str], moves: dict[tuple[str, str], str]) -> DataFrame:
    """The rows with ``before`` and ``state``, a finite machine's states before and after each row's event; it starts in ``states[0]``.

    ``moves``: (event, state) to the next state; without an entry the state stays.
    """
    place = {s: n for n, s in enumerate(states)}
    same = list(range(len(states)))
    table: dict[str, list[int]] = {}
    for (e, s), to in moves.items():
        table.setdefault(e, list(same))[place[s]] = place[to]

    held = numbered(rows, key, order)
    kind = held.schema[key].dataType.simpleString()
    slim = held.select(F.col(key).alias("key"), "piece", "at", F.col(event).alias("event"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(key, piece, rows) of rows that stand by key and piece."""
        last, kept = None, []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
                if kept and row[:2] != last:
                    yield (*last, kept)
                    kept = []
                last = row[:2]
                kept.append(row)
        if kept:
            yield (*last, kept)

    def made(found: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row in found:
            out.append(row)
            if len(out) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def dealt(df: DataFrame, work, ddl: str) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = to_arrow_schema(StructType.fromDDL(ddl))
        return df.repartition("key", "piece").sortWithinPartitions("key", "piece", "at").mapInArrow(lambda batches: made(work(batches), schema), ddl)

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for k, piece, kept in runs(batches):
            does = same
            for _, _, _, e in kept:
                step = table.get(e)
                does = [step[s] for s in does] if step else does
            yield k, piece, does

    def begun(group: pa.Table) -> pa.Table:
        group = group.sort_by("piece")
        state, out = 0, []
        for does in group.column("does").to_pylist():
            out.append(state)
            state = does[state]
        return pa.table({"key": group.column("key"), "piece": group.column("piece"), "begins": pa.array(out, pa.int32())})

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, _, kept in runs(batches):
            state = kept[0][4]  # the piece's own row stands first
            for _, _, at, e, _ in kept[1:]:
                before, step = state, table.get(e)
                state = step[state] if step else state
                yield at, states[before], states[state]

    pieces = stored(dealt(slim, composed, f"key {kind}, piece long, does array<int>"), "piece-functions")
    starts = pieces.groupBy("key").applyInArrow(begun, f"key {kind}, piece long, begins int")
    heads = starts.select("key", "piece", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("event"), "begins")
    both = heads.unionByName(slim.withColumn("begins", F.lit(None).cast("int")))
    found = dealt(both, walked, "at long, before string, state string")
    return held.join(found, "at").drop("at", "piece")
