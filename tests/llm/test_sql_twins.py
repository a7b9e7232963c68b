"""Operators with a SQL twin, on a whole table."""

import duckdb
import pytest

from citewell.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_lexical_search"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert rows and sorted(rows) == sorted(want.select(*columns).fetchall())
