"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import duckdb
import pytest

from tessera.plans import catalog, surrogates

DATA = "/root/testdata/sf0.001"
TABLES = ("orders", "lineitem", "events", "documents", "conversations", "customer", "part", "pages", "embeddings", "labels")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = [sorted(map(str, x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False, name=None))) for x in (ours, theirs)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_the_others_run(spark, name):
    assert len(catalog.QUERIES[name](spark, DATA).toPandas()) > 0


def test_letters_of_the_surrogates_map_one_to_one():
    assert len(surrogates.ACCENTS) == len(surrogates.MARKS) == len(set(surrogates.MARKS))
