"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from newtonmill.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    order = sorted(names)
    assert sorted(found.columns) == order
    left = sorted(tuple(str(r[c]) for c in order) for r in found.collect())
    assert left == sorted(tuple(str(r[names.index(c)]) for c in order) for r in want.fetchall())


def test_row_index_is_the_order_of_keys(spark):
    from newtonmill.operators.partition import row_index

    t = spark.range(1000).selectExpr("(id * 7919) % 1009 as k")
    rows = row_index(t, "k").orderBy("k").collect()
    assert [r.sample_id for r in rows] == list(range(1000))
    assert row_index(t.limit(0), "k").count() == 0
