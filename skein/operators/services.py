"""Provider arguments: any function from texts to text serves as a language model; its calls run in the tasks.

``respond`` and ``generate`` apply a model to rows; the services built on them (titles, classification, distilled facts,
summaries, reports, expansions, answers) take the model as an argument, and none is made up here.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text
from skein.functions.json_text import balanced

#: (instructions, prompt) -> reply; may raise.
Model = Callable[[str, str], str]
ATTEMPTS = 3
NUDGE = "\n\nThe last reply was no valid JSON with these fields. Reply with the JSON object alone."


def _with_text(rows: DataFrame, name: str, run: Callable[[str | None], str | None]) -> DataFrame:
    """``rows`` with a text column made from the column ``prompt`` row by row in Arrow batches."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [run(p) for p in batch.column(batch.schema.get_field_index("prompt")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, name])

    return rows.mapInArrow(work, f"{fields}, `{name}` string")


def respond(rows: DataFrame, model: Model, instructions: str) -> DataFrame:
    """``rows`` (with prompt) and the model's ``reply``; null where the prompt is null or the model fails."""

    def one(prompt: str | None) -> str | None:
        if prompt is None:
            return None
        try:
            return model(instructions, prompt)
        except Exception:  # noqa: BLE001  a provider may raise anything; its failure is a null reply
            return None

    return _with_text(rows, "reply", one)


def decoded(reply: str, fields: tuple[str, ...]) -> str | None:
    """The first JSON object of a reply, if it has all fields."""
    found = balanced(reply)
    try:
        made = json.loads(found) if found else None
    except json.JSONDecodeError:
        made = None
    return json.dumps(made, sort_keys=True, ensure_ascii=False) if isinstance(made, dict) and set(fields) <= made.keys() else None


def guided(model: Model, instructions: str, prompt: str, fields: tuple[str, ...], attempts: int = ATTEMPTS) -> str | None:
    """A JSON object with the fields as canonical text: the model is asked again, more strictly, where a reply has none."""
    system = f"{instructions}\n\nReply with a JSON object with the fields {', '.join(fields)}."
    for attempt in range(attempts):
        try:
            made = decoded(model(system + (NUDGE if attempt else ""), prompt), fields)
        except Exception:  # noqa: BLE001
            made = None
        if made is not None:
            return made
    return None


def generate(rows: DataFrame, model: Model, instructions: str, fields: tuple[str, ...], attempts: int = ATTEMPTS) -> DataFrame:
    """``rows`` (with prompt) and ``json``, the guided reply; null where all attempts fail."""
    return _with_text(rows, "json", lambda p: None if p is None else guided(model, instructions, p, fields, attempts))


# Services


def expansions(queries: DataFrame, model: Model) -> DataFrame:
    """query_id, alt_no, text: other phrasings of queries (query_id, text), one a line, list marks stripped; failures have none."""
    asked = respond(queries.select("query_id", F.col("text").alias("prompt")), model, "Rewrite the search query in two other ways, one a line.")
    lines = text.strip_list_markers(F.coalesce("reply", F.lit("")))
    return asked.select("query_id", F.posexplode(lines).alias("at", "text")).select("query_id", (F.col("at") + 1).alias("alt_no"), "text")


def titles(sessions: DataFrame, model: Model) -> DataFrame:
    """session_id, title of sessions (session_id, text); null where the model has no usable one."""
    asked = respond(sessions.select("session_id", F.col("text").alias("prompt")), model, "Name this conversation in a few words.")
    return asked.select("session_id", text.title_from(F.col("reply")).alias("title"))


def classify(clusters: DataFrame, model: Model) -> DataFrame:
    """cluster, name of clusters (cluster, text); blank replies are none."""
    asked = respond(clusters.select("cluster", F.col("text").alias("prompt")), model, "Name the kind of these meetings in one or two words.")
    name = text.strip(F.col("reply"))
    return asked.select("cluster", F.when(name != "", name).alias("name"))


def distil(sessions: DataFrame, model: Model) -> DataFrame:
    """session_id, kind, text: lasting facts of sessions (session_id, text), from a guided reply."""
    asked = generate(sessions.select("session_id", F.col("text").alias("prompt")), model, "List lasting facts.", ("facts",))
    facts = F.from_json("json", "facts array<struct<kind:string,text:string>>")["facts"]
    return asked.select("session_id", F.explode(facts).alias("f")).select("session_id", "f.kind", "f.text")


def summarise(calls: DataFrame, model: Model) -> DataFrame:
    """session_id, stage, number, json of summary calls (session_id, stage, number, prompt)."""
    return generate(calls, model, "Summarise.", ("overview",)).select("session_id", "stage", "number", "json")


def reports(sessions: DataFrame, model: Model, available: bool = True) -> DataFrame:
    """session_id, state, json: the report of sessions (session_id, text), ready, failed or unavailable."""
    rows = sessions.select("session_id", F.col("text").alias("prompt"))
    if not available:
        return rows.select("session_id", F.lit("unavailable").alias("state"), F.lit(None).cast("string").alias("json"))
    made = generate(rows, model, "Report.", ("overview",))
    return made.select("session_id", F.when(F.col("json").isNull(), "failed").otherwise("ready").alias("state"), "json")


def answer_result(available: Column, has_context: Column, first: Column, second: Column, used_context: Column) -> Column:
    """What a question comes to: grounded, conversational, or retrievalOnly with its reason.

    ``first`` and ``second``: the outcomes of the call and of its one repetition without the last passage, each ok,
    overflow or error.
    """
    outcome = F.when(first == "overflow", second).otherwise(first)
    return (
        F.when(~available, "retrievalOnly:tierB")
        .when(outcome == "overflow", "retrievalOnly:contextOverflow")
        .when(outcome == "error", "retrievalOnly:generationFailed")
        .when(used_context & has_context, "grounded")
        .otherwise("conversational")
    )


def fit_passages(passages: Column, tokens: Column, budget: Column) -> Column:
    """Passages of a call: all, or all but the last where their tokens exceed the budget (that is tried once)."""
    used = F.aggregate(tokens, F.lit(0).cast("long"), lambda s, n: s + n)
    return F.when((used > budget) & (F.size(passages) > 1), F.slice(passages, 1, F.size(passages) - 1)).otherwise(passages)
