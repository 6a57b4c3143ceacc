"""Every query answers; every SQL twin names a query."""

import importlib

import __spark_entry__ as entry


def test_catalogue_is_consistent(spark):
    from finwake.plans import catalog

    q, o = catalog.queries(), catalog.oracle_sql()
    assert set(o) <= set(q) and set(q) - set(o) == {"boosted_scores", "gbt_scores", "logistic_scores", "demo_transactions"}
    importlib.reload(entry)
    assert set(q) <= set(entry.queries())


def test_against_sql(spark):
    import duckdb

    from finwake.plans import catalog

    con = duckdb.connect()
    for t in ("events", "lineitem", "orders", "customer", "supplier"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    for name in ("feature_table_onepass", "budget_metrics", "recall_ceiling", "ranking_quality", "first_thin_day"):
        got = catalog.queries()[name](spark, "/root/testdata/sf0.001")
        want = con.execute(catalog.oracle_sql()[name]).fetchall()
        names = [d[0] for d in con.description]
        rows = [tuple(r[n] for n in names) for r in got.collect()]
        assert sorted(map(str, rows)) == sorted(map(str, want)), name
