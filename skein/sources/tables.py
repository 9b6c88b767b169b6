"""Mutations of stored tables as functions from frames to frames, and exports."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text
from skein.operators.batches import map_batches
from skein.sources.shared import file_system, make_dir, remove


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def split_orphans(children: DataFrame, parents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Children with a parent, and those without."""
    known = parents.select(key).distinct()
    return children.join(known, key, "left_semi"), children.join(known, key, "left_anti")


def update(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Named columns set from the changes where these are not null; unknown keys change nothing."""
    fresh = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.join(fresh, key, "left")
    return joined.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def rename_placeholder(rows: DataFrame, titles: DataFrame, key: str, placeholder) -> DataFrame:
    """New titles only where the title is still the placeholder."""
    joined = rows.join(titles.select(key, F.col("title").alias("__new")), key, "left")
    fresh = F.when((F.col("title") == placeholder) & F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col("title"))
    return joined.select(*[fresh.alias("title") if c == "title" else F.col(c) for c in rows.columns])


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def upsert(stored: DataFrame, fresh: DataFrame, key: str, version: str) -> DataFrame:
    """The latest version of each key; of equal versions the fresh row."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    order = Window.partitionBy(key).orderBy(F.desc(version), F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n", "__new")


def transcript(sessions: DataFrame, segments: DataFrame, markdown: bool = True) -> DataFrame:
    """session_id, body: a session's transcript as markdown or plain text."""
    mark = F.concat(F.lit("**["), text.clock(F.col("start")), F.lit("]** ")) if markdown else F.concat(F.lit("["), text.clock(F.col("start")), F.lit("] "))
    lines = segments.select("session_id", "start", F.concat(mark, F.coalesce("text", F.lit(""))).alias("line"))
    body = lines.groupBy("session_id").agg(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY start)").alias("lines"))
    date, length = text.stamp(F.col("created_at")), text.duration(F.col("duration"))
    if markdown:
        head = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n**Date:** "), date, F.lit("\n**Duration:** "), length, F.lit("\n\n## Transcript\n\n"))
    else:
        head = F.concat(F.col("title"), F.lit("\nDate: "), date, F.lit("\nDuration: "), length, F.lit("\n\n"))
    return sessions.join(body, "session_id", "left").select("session_id", F.concat(head, F.coalesce("lines", F.lit("")), F.lit("\n")).alias("body"))


def summary_markdown(summary) -> "F.Column":
    """A summary struct (overview, key_decisions, action_items, risks, open_questions) as sections; empty ones left out."""

    def section(name: str, items, last: bool = False):
        return F.when(F.size(items) > 0, F.concat(F.lit(f"**{name}**\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("" if last else "\n")))

    actions = F.transform(summary["action_items"], lambda x: F.concat(x["text"], F.coalesce(F.concat(F.lit(" ("), x["owner"], F.lit(")")), F.lit(""))))
    return F.concat_ws(
        "\n", F.when(summary["overview"] != "", F.concat(summary["overview"], F.lit("\n"))), section("Key Decisions", summary["key_decisions"]),
        section("Action Items", actions), section("Risks", summary["risks"]), section("Open Questions", summary["open_questions"], True),
    )


def reminders(items: DataFrame) -> DataFrame:
    """Drafts of action items (text, owner, title): blank items dropped, the owner named only if there is one."""
    body, owner = text.strip(F.col("text")), text.strip(F.coalesce("owner", F.lit("")))
    notes = F.concat(F.lit("From meeting: "), F.col("title"), F.when(owner != "", F.concat(F.lit("\nOwner: "), owner)).otherwise(F.lit("")))
    return items.filter(body != "").withColumn("reminder", body).withColumn("notes", notes)


#: Name of the file of rows without a name; no other name is escaped to it.
NAMELESS = "%"


def _escaped(name: str | None) -> str:
    """A session's name as that of a file: what paths can't hold, and a first character that hides a file, as %XX."""
    return re.sub(r"[%/:\x00-\x1f\x7f]|\A[._]", lambda m: f"%{ord(m[0]):02X}", name) if name else NAMELESS


def _move(files, temporary: str, final: str) -> None:
    """Rename a whole file to its name, over that of an earlier attempt."""
    from pyarrow import fs

    try:
        files.move(temporary, final)
    except OSError:  # not every file system renames over a file
        if files.get_file_info(final).type == fs.FileType.NotFound:
            raise
        files.delete_file(final)
        files.move(temporary, final)


def export_all(bodies: DataFrame, folder: str) -> None:
    """One text file per session: the body and a line end, in ``folder``, which is emptied first. Bodies of one name share a file.

    Tasks write the files, under temporary names until they are whole: no folders, and no file is left for the driver to move.
    """
    spark = bodies.sparkSession
    remove(spark, [folder])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(folder)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        done = 0
        for name, group in groupby(rows, key=lambda row: row[0]):
            if not done:
                files.create_dir(f"{root}/_temporary", recursive=True)
            temporary = f"{root}/_temporary/{uuid.uuid4().hex}"
            with files.open_output_stream(temporary) as out:
                for _, body in group:
                    out.write(f"{body or ''}\n".encode())
            _move(files, temporary, f"{root}/{_escaped(name)}.md")
            done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["files"])

    named = bodies.select(F.nullif("file_name", F.lit("")).alias("file_name"), "body")
    map_batches(named.repartition("file_name").sortWithinPartitions("file_name"), run, "files long").agg(F.sum("files")).collect()
    make_dir(spark, folder)  # also where there are no sessions
    remove(spark, [f"{folder}/_temporary"])


def exported(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, value: the files of an export, read back whole."""

    def unescaped(name):
        return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))

    name = F.regexp_replace(unescaped(F.col("_metadata.file_name")), r"\.md\z", "")  # Spark gives names as in URLs
    name = F.when(name != NAMELESS, unescaped(name))
    return spark.read.text(folder, wholetext=True).select(name.alias("file_name"), "value")


def wipe(rows: DataFrame, path: str) -> None:
    """Overwrite a stored table with an empty one of the same columns."""
    rows.limit(0).write.mode("overwrite").parquet(path)
