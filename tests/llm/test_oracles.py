"""The newer queries with SQL give the rows that DuckDB gives."""

import duckdb
import pytest

from newtonmill.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["spotsigs_classes", "chat_layouts"])
def test_rows_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    found = QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(names)
    assert sorted(tuple(str(r[c]) for c in names) for r in found.collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())
