"""Predicates: search, routing, guards."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text

if TYPE_CHECKING:
    from skein.operators.substrings import SubstringIndex

#: Words by which a question leans on what was said before.
CONTEXT_WORDS = ("it", "that", "this", "they", "them", "he", "she", "him", "her", "his", "hers", "their", "those", "these", "one")


def matches(column: Column, query: str) -> Column:
    """Substring search that minds neither case nor accents."""
    return F.contains(F.collate(column, "UNICODE_CI_AI"), F.collate(F.lit(query), "UNICODE_CI_AI"))


def search_sessions(sessions: DataFrame, segments: DataFrame, query: str, index: SubstringIndex | None = None) -> DataFrame:
    """Sessions whose title or any segment holds the query; a blank query finds all. ``index``: of the segments' texts."""
    if not query.strip():
        return sessions.orderBy(F.desc("created"), "session_id")
    held = index.search(query) if index is not None else segments.filter(matches(F.col("text"), query.strip()))
    hits = held.select("session_id", F.lit(True).alias("__hit")).distinct()
    found = sessions.join(hits, "session_id", "left").filter(matches(F.col("title"), query.strip()) | F.col("__hit"))
    return found.drop("__hit").orderBy(F.desc("created"), "session_id")


def in_category(tags: Column, category: str) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit(1)) == category, F.lit(False))


def needs_rewrite(question: Column) -> Column:
    """Under four tokens, or a context word among them."""
    tokens = text.tokenize(question)
    return (F.size(tokens) < 4) | F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in CONTEXT_WORDS]))


def is_relevant(body: Column, source: Column, expected: Column, expected_source: Column) -> Column:
    return F.contains(F.lower(body), F.lower(expected)) | (source == expected_source)


def speech_onset(heard: Column) -> Column:
    """At least five characters and two words."""
    s = text.strip(heard)
    return (F.length(s) >= 5) & (text.word_count(s) >= 2)


def embedder_choice(selected: Column, downloaded: Column) -> Column:
    return F.when(selected & downloaded, F.lit("upgrade")).otherwise(F.lit("builtin"))


def needs_rebuild(choice: Column, active: Column) -> Column:
    """Whether an index was built by another embedder; an index never built is fresh."""
    return F.coalesce(active != choice, F.lit(False))


def backend(preference: Column, heat: Column, hosted_ready: Column, local_ready: Column) -> Column:
    """Which generator serves a request: none at critical heat, no local one at serious heat."""
    local = local_ready & (heat != "serious")
    none = F.lit("retrieval")
    return (
        F.when(heat == "critical", none)
        .when(preference == "hosted", F.when(hosted_ready, "hosted").otherwise(none))
        .when(preference == "local", F.when(local, "local").otherwise(none))
        .when(preference == "auto", F.when(hosted_ready, "hosted").when(local, "local").otherwise(none))
        .otherwise(F.when(local, "local").when(hosted_ready, "hosted").otherwise(none))
    )
