"""Substring search by trigrams: postings of folded text are intersected, and what they leave is verified.

Matching minds neither case nor accents, by the collation UNICODE_CI_AI, as ``predicates.matches`` does. Texts are folded
(case, compatibility forms, marks, digits) to find their trigrams of ASCII letters and digits. Characters that the
collation may hold equal to ASCII ones though folding leaves them (a Latin letter with a stroke, an ignorable control)
make a text odd; odd texts are always verified, so that the postings never lose a match.

Rows lie in blocks of ``BLOCK``, blocks in ``SHARDS`` folders; postings lie in ``SHARDS`` folders by trigram and are sorted by it. A
search reads the folders of its trigrams, and of the texts only blocks that have candidates.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.operators.predicates import matches
from skein.sources.shared import scratch

BLOCK, SHARDS = 512, 64
#: Up to so many candidate blocks are named in the filter that the text scan gets; more are joined.
MANY_BLOCKS = 10_000
#: Stands for oddness among the trigrams.
ODD = -1
GRAMS = "gram int, block long, places array<int>, shard int"
_CODE = np.zeros(256, np.int64)
for _n, _c in enumerate(b"abcdefghijklmnopqrstuvwxyz0123456789"):
    _CODE[_c] = _n + 1
_KEPT = ("CYRILLIC", "GREEK", "CJK", "HIRAGANA", "KATAKANA", "HANGUL", "ARABIC", "HEBREW", "DEVANAGARI", "THAI")
_CONTROL = re.compile(r"[\x00-\x08\x0E-\x1F\x7F]")


def fold(text: str) -> tuple[str, bool]:
    """The text folded, and whether it is odd."""
    if text.isascii():
        return text.lower(), bool(_CONTROL.search(text))
    out, odd = [], False
    for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold()):
        if c.isascii():
            odd |= bool(_CONTROL.match(c))
        else:
            kind = unicodedata.category(c)
            if kind == "Mn":
                continue
            if kind == "Nd":
                c = str(unicodedata.decimal(c))
            elif kind[0] != "P" and kind != "Sc" and not unicodedata.name(c, "").startswith(_KEPT):
                odd = True
        out.append(c)
    return "".join(out), odd


def trigrams(folded: str) -> np.ndarray:
    """Codes of a folded text's trigrams of ASCII letters and digits, each once."""
    c = _CODE[np.frombuffer(folded.encode("utf-8", "surrogatepass"), np.uint8)]
    if len(c) < 3:
        return np.empty(0, np.int64)
    every = (c[:-2] * 37 + c[1:-1]) * 37 + c[2:]
    return np.unique(every[(c[:-2] > 0) & (c[1:-1] > 0) & (c[2:] > 0)])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, place, text) as (gram, block, places)."""
    for batch in batches:
        block = np.asarray(batch.column(0), np.int64)
        place = np.asarray(batch.column(1), np.int64)
        found = []
        for text in batch.column(2):
            folded, odd = fold(text.as_py() or "")
            found.append(np.append(trigrams(folded), ODD) if odd else trigrams(folded))
        if not found:
            continue
        row = np.repeat(np.arange(len(found)), [len(x) for x in found])
        gram = np.concatenate(found)
        order = np.lexsort((place[row], block[row], gram))
        gram, row = gram[order], row[order]
        if not len(gram):
            continue
        cut = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (block[row[1:]] != block[row[:-1]])]))
        places = pa.ListArray.from_arrays(pa.array(np.append(cut, len(gram)), pa.int32()), pa.array(place[row], pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(gram[cut], pa.int32()), pa.array(block[row[cut]], pa.int64()), places], ["gram", "block", "places"])


class SubstringIndex:
    """Rows with a text column, and the trigrams of their texts, below a folder."""

    def __init__(self, spark: SparkSession, path: str, column: str = "text", schema: StructType | None = None) -> None:
        self.spark, self.path, self.column, self.schema = spark, path.rstrip("/"), column, schema

    def _rows(self) -> DataFrame:
        reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
        return reader.parquet(f"{self.path}/rows")

    @classmethod
    def build(cls, rows: DataFrame, column: str = "text", path: str | None = None) -> SubstringIndex:
        """Index ``rows`` into ``path``, or a fresh path in the shared folder. Two passes without a shuffle of the texts."""
        spark = rows.sparkSession
        made = cls(spark, path or scratch(spark, "substring-index"), column)
        number = F.monotonically_increasing_id()
        kept = rows.withColumn("__n", number).withColumn("__block", F.floor(F.col("__n") / BLOCK)).withColumn("__place", (F.col("__n") % BLOCK).cast("int")).drop("__n")
        kept = kept.withColumn("__shard", F.pmod("__block", F.lit(SHARDS)).cast("int"))
        made.schema = kept.schema
        kept.write.partitionBy("__shard").parquet(f"{made.path}/rows")
        texts = made._rows().select("__block", "__place", column)
        grams = texts.mapInArrow(_postings, "gram int, block long, places array<int>").withColumn("shard", F.pmod("gram", F.lit(SHARDS)).cast("int"))
        grams.repartition("shard").sortWithinPartitions("shard", "gram", "block").write.partitionBy("shard").parquet(f"{made.path}/grams")
        return made

    def candidates(self, query: str) -> DataFrame | None:
        """(block, place) of rows that may hold the query; none where its trigrams don't tell: under three letters, or odd itself."""
        folded, odd = fold(query)
        grams = [] if odd or not folded.isascii() else trigrams(folded).tolist()
        if not grams:
            return None
        wanted = [*grams, ODD]
        shards = sorted({g % SHARDS for g in wanted})
        held = self.spark.read.schema(GRAMS).parquet(f"{self.path}/grams").filter(F.col("shard").isin(shards) & F.col("gram").isin(wanted))
        rows = held.select("block", F.explode("places").alias("place"), "gram").groupBy("block", "place")
        counted = rows.agg(F.count_if(F.col("gram") != ODD).alias("n"), F.max(F.col("gram") == ODD).alias("odd"))
        return counted.filter(F.col("odd") | (F.col("n") == len(grams))).select("block", "place")

    def search(self, query: str) -> DataFrame:
        """Rows whose text holds the query; a blank query finds all."""
        rows = self._rows()
        ask = query.strip()
        plain = [c for c in rows.columns if not c.startswith("__")]
        if not ask:
            return rows.select(plain)
        found = self.candidates(ask)
        if found is not None:
            blocks = [r[0] for r in found.select("block").distinct().limit(MANY_BLOCKS + 1).collect()]
            if len(blocks) <= MANY_BLOCKS:
                rows = rows.filter(F.col("__shard").isin(sorted({b % SHARDS for b in blocks})) & F.col("__block").isin(blocks))
            rows = rows.join(found, (F.col("__block") == F.col("block")) & (F.col("__place") == F.col("place")), "left_semi")
        return rows.filter(matches(F.col(self.column), ask)).select(plain)
