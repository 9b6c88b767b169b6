"""Text functions as Column factories: cleaning, tokens, names, dates, prompts. Lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{M}\p{N}]+"
CHARS_PER_TOKEN = 3.5


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_estimate(text: Column) -> Column:
    """ceil(characters / 3.5)."""
    return F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("long")


def fits(instructions: Column, prompt: Column, reserve: Column, context: int = 4096) -> Column:
    return (instructions + prompt + reserve) <= context


def clean(text: Column) -> Column:
    """Line ends, control characters, hyphenated breaks, blanks, trailing blanks, blank lines; in that order."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[\x00-\x08\x0B-\x1F\x7F]", "")
    t = F.regexp_replace(t, r"-\n(\p{Ll})", "$1")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r" +\n", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(t)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def preview(text: Column, size: int = 160) -> Column:
    """White space collapsed, then the first characters."""
    return F.left(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(size))


def normal_key(text: Column) -> Column:
    return F.lower(strip(text))


def clock(seconds: Column) -> Column:
    """HH:MM:SS; negative counts as zero, fractions are cut."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def duration(seconds: Column) -> Column:
    """"1h 2m 5s" without leading zero units."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return (
        F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))
    )


def stamp(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd HH:mm")


def file_name(title: Column) -> Column:
    """Characters that file systems dislike become a dash; blank titles a default."""
    safe = strip(F.translate(title, '/\\:?%*|"<>', "----------"))
    return F.when(safe == "", F.lit("Session")).otherwise(safe)


def strip_list_markers(text: Column) -> Column:
    """Lines without their list markers; empty lines dropped."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[\p{N}.)\-• ]+", "")))
    return F.filter(lines, lambda x: x != "")


def join_pages(pages: Column) -> Column:
    """Pages joined by a blank line and the offset at which each starts."""
    text = F.array_join(pages, "\n\n")
    offsets = F.aggregate(
        pages,
        F.struct(F.array().cast("array<bigint>").alias("o"), F.lit(0).cast("long").alias("at")),
        lambda s, p: F.struct(F.concat(s["o"], F.array(s["at"])).alias("o"), (s["at"] + F.length(p) + 2).alias("at")),
        lambda s: s["o"],
    )
    return F.struct(text.alias("text"), offsets.alias("offsets"))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))).cast("long")


def halves(text: Column) -> Column:
    """A text split in the middle of its sentences (". "), or of its characters where it has but one."""
    parts = F.split(text, r"\. ")
    n = F.size(parts)
    half = F.floor(n / 2).cast("int")
    by_sentence = F.array(F.array_join(F.slice(parts, F.lit(1), half), ". "), F.array_join(F.slice(parts, half + 1, n - half), ". "))
    middle = F.floor(F.length(text) / 2).cast("int")
    return F.when(n > 1, by_sentence).otherwise(F.array(F.substr(text, F.lit(1), middle), F.substr(text, middle + 1)))


def numbered(position: Column, text: Column) -> Column:
    return F.concat(F.lit("["), position.cast("string"), F.lit("] "), text)


def sections(*parts: Column) -> Column:
    """Sections of a prompt, blank ones left out."""
    kept = [F.when(strip(p) != "", p) for p in parts]
    return F.concat_ws("\n\n", *kept)


def percent(value: Column) -> Column:
    return F.concat(F.round(value * 100).cast("int").cast("string"), F.lit("%"))


#: What a generated title is stripped of, and titles that say nothing.
TITLE_STRIP = "[ \\t\"'“”‘’.,:;!]+"
GENERIC_TITLES = ("meeting", "discussion", "untitled", "notes")


def title_from(raw: Column) -> Column:
    """A generated title made safe: first line, label and quotes stripped, at most 60 characters at a word; null if useless."""
    line = F.split(strip(raw), "\n")[0]
    line = F.regexp_replace(line, "^(Title:|title:|TITLE:)", "")
    line = F.regexp_replace(line, f"^{TITLE_STRIP}|{TITLE_STRIP}$", "")
    cut = F.when(F.length(line) > 60, F.trim(F.regexp_replace(F.left(line, F.lit(60)), " [^ ]*$", ""))).otherwise(line)
    return F.when((F.length(cut) >= 3) & ~F.lower(cut).isin(*GENERIC_TITLES), cut)
