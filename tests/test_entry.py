"""The driver contract."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "citation_verdicts" in queries and len(queries) > 35


@needs_data
def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and "support_verdict" in rows.columns


@needs_data
def test_oracles(spark):
    """Every query of the ledger that SQL can express gives the same rows as its SQL."""
    duckdb = pytest.importorskip("duckdb")
    from parley.plans import cases, catalog  # noqa: F401
    from parley.plans.registered import ORACLE_SQL, QUERIES

    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "events", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        rows = QUERIES[name](spark, SF)
        columns = sorted(rows.columns)
        got = [tuple(r[k] for k in columns) for r in rows.collect()]
        found = c.execute(sql)
        places = sorted(range(len(columns)), key=lambda i: found.description[i][0])
        want = [tuple(r[i] for i in places) for r in found.fetchall()]
        assert sorted(d[0] for d in found.description) == columns, name
        assert sorted(map(repr, got)) == sorted(map(repr, want)), name
