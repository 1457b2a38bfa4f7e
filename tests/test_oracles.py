"""Each query with SQL gives what DuckDB gives on the same tables."""

import math
import os

import pytest

from corvane.queries import QUERIES, SQL

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(rows, columns):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "-"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.6f}".replace("-0.000000", "0.000000") if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(plain(r[c]) for c in columns) for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    rows = [r.asDict() for r in found.collect()]
    spark.catalog.clearCache()
    if name not in SQL:
        assert found.columns
        return
    expected = duck.sql(SQL[name])
    columns = sorted(expected.columns)
    assert sorted(found.columns) == columns
    want = [dict(zip(expected.columns, r)) for r in expected.fetchall()]
    assert _rows(rows, columns) == _rows(want, columns)
