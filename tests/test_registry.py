"""Every query against its DuckDB oracle, on the smallest tables."""

import duckdb
import pytest

from ledgerframe.plans import models, registry, reports  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    said = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in said.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLE.keys()))
def test_query_without_oracle_has_rows(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    assert df.limit(1).count() == 1
