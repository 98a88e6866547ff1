"""The SQL of the queries against the queries themselves, on small real tables."""

import math

import duckdb
import pytest

from lattica.llm import queries

TABLES = "/root/testdata/sf0.01"
NAMES = "documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    found = queries.queries()[name](spark, TABLES)
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(names, want.fetchall())


def test_every_dealt_operator_has_one_query():
    numbers = [int(name[2:].split("_")[0]) for name in queries.queries()]
    assert sorted(numbers) == [*range(1, 14)]
