"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = {n: s for n, s in entry.oracle_sql().items() if n in entry.queries()}


def canonical(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    rows = pdf.where(pdf.notna(), None).itertuples(index=False, name=None)
    return sorted(tuple(str(int(x)) if isinstance(x, float) and x.is_integer() else str(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_search_plan_reads_two_columns_and_never_shuffles_vectors(spark):
    df = entry.queries()["vector_topk"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<chunk_id:string,embedding:array<float>>" in plan
    assert "CartesianProduct" not in plan
