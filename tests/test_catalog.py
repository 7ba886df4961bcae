"""Every named query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from redgreen.plans.catalog import QUERIES
from redgreen.plans.checks import CHECKS

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


def comparable(rows):
    def one(x):
        return repr(round(x, 9) + 0.0) if isinstance(x, float) else repr(x)

    return sorted(tuple(map(one, row)) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(CHECKS)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, sql, name):
    result = QUERIES[name](spark, SF_DIR)
    columns = sorted(result.columns)
    answer = sql.execute(CHECKS[name])
    names = [x[0] for x in answer.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = comparable([row[i] for i in places] for row in answer.fetchall())
    assert comparable(tuple(row[c] for c in columns) for row in result.collect()) == want
