"""Every query of the blob engine against its SQL twin."""

import duckdb
import pytest

from sedimark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def database(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


def same(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(name, spark, sf, database):
    df = registry.queries()[name](spark, sf)
    found = database.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    wanted = sorted((tuple(map(same, r)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(same(r[c]) for c in columns) for r in df.collect()), key=repr) == wanted


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) ))
def test_other_queries_run(name, spark, sf):
    # Rows are collected, since count() would leave out what makes their columns.
    df = registry.queries()[name](spark, sf)
    rows = df.collect()
    assert rows and all(len(r) == len(df.columns) for r in rows)


def test_entry_stands_without_the_subpackage():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
