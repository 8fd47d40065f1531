"""Every registered query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from fieldloom.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, con, name):
    got = registry.queries()[name](spark, DIR)
    want = con.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert key(got.select(*columns).collect()) == key(want.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_oracle_runs(spark, name):
    assert registry.queries()[name](spark, DIR).count() > 0
