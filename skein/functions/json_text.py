"""JSON inside noisy text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def balanced(text: str) -> str | None:
    """The first balanced object of a text, braces in strings not counted; None if there is none."""
    start = text.find("{")
    while start >= 0:
        depth, quoted, escaped = 0, False, False
        for k in range(start, len(text)):
            c = text[k]
            if quoted:
                if escaped:
                    escaped = False
                elif c == "\\":
                    escaped = True
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if depth == 0:
                    return text[start : k + 1]
        start = text.find("{", start + 1)
    return None


def _first(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: None if t is None else balanced(t))


def first_object(text: Column) -> Column:
    return F.pandas_udf(_first, "string")(text)
