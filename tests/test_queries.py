"""Every registered query of the reference's operators against DuckDB on the smallest tables, or its row count."""

import math

import duckdb
import pytest

from skein.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries without SQL: tests/test_folds.py compares their rows with plain versions.
PLAIN = {"ir_8_chunk_documents", "ir_9_chunk_sessions", "ir_10_index_build", "ir_11_embed", "ir_23_self_retrieval", "ext_2_chunk_udtf", "snk_8_rebuild", "str_4_sentences"}
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    if name not in ORACLES:
        assert got and name in PLAIN
        return
    done = duck.execute(ORACLES[name])
    columns = [d[0] for d in done.description]
    assert sorted(columns) == names
    assert got == sorted(repr([plain(r[columns.index(c)]) for c in names]) for r in done.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
