"""Every registered query with SQL against DuckDB on the small tables."""

import os

import duckdb
import pytest

from loomgraph.plans.catalog import CATALOG

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "events")


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple("" if r[i] is None else str(r[i]) for i in order) for r in rows))


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, name):
    q = CATALOG[name]
    df = q.run(spark, SF)
    got = [tuple(r) for r in df.collect()]
    if not q.sql:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(q.sql)
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    fix = lambda rows: [tuple(str(x).lower() if isinstance(x, bool) else x for x in r) for r in rows]
    assert plain(fix(got), df.columns) == plain(fix(want), rel.columns)
