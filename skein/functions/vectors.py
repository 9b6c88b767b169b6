"""Vector functions. Numbers are taken as doubles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 for vectors of different length."""
    total = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.lit(0.0))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def normalise(v: Column) -> Column:
    """Unit length; vectors of length up to 1e-6 stay as they are."""
    n = norm(v)
    return F.when(n > EPSILON, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def same_size(a: Column, b: Column) -> Column:
    return F.size(a) == F.size(b)


def _pack(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Little-endian float32 bytes."""
    for s in vectors:
        yield s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def _unpack(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The vector of packed bytes; null where their number is no multiple of four."""
    for s in blobs:
        yield s.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").tolist())


def pack(vector: Column | str) -> Column:
    return F.pandas_udf(_pack, "binary")(vector)


def unpack(blob: Column | str) -> Column:
    return F.pandas_udf(_unpack, "array<float>")(blob)
