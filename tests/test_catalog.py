"""Every registered query against its SQL, on the smallest data."""

import duckdb
import pandas as pd
import pytest

from cairnlake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(df):
    cell = lambda x: None if pd.isna(x) else int(x) if isinstance(x, float) and x == int(x) else f"{x:.9g}" if isinstance(x, float) else x
    return sorted((tuple(str(cell(x)) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sql, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE:
        want = sql.sql(catalog.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_plan_moves_payloads_for_ids(spark):
    plan = catalog.QUERIES["diff_paths"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
