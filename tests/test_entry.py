"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
GRAPH = [k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline"]


def same(df, relation):
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    key = lambda rows, names: sorted(tuple(str(r[names.index(c)]) for c in columns) for r in rows)
    return key(df.collect(), df.columns) == key(relation.fetchall(), relation.columns)


@pytest.fixture(scope="module")
def sql(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", GRAPH)
def test_query_matches_its_sql(spark, sf, sql, name):
    assert same(entry.queries()[name](spark, sf), sql.sql(entry.oracle_sql()[name]))


def test_flagship(spark):
    assert 0 < entry.entry(spark).count() <= 20
