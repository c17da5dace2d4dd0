"""The relational queries against SQL, on the small driver tables where they are, and on made ones."""

import os

import duckdb
import pytest

from weftgraph.plans import catalog_queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    if not os.path.isdir(FOLDER):
        pytest.skip("no driver tables here")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(v[i], 9) if isinstance(v[i], float) else v[i] for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalog_queries.SQL))
def test_query_matches_sql(spark, oracle, name):
    found = catalog_queries.QUERIES[name](spark, FOLDER)
    cursor = oracle.execute(catalog_queries.SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(found.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(names, cursor.fetchall())
