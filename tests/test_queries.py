"""Every registered query against its SQL on DuckDB, and plans that must not appear."""

import os
import re

import duckdb
import pytest
from check import TABLES, rows_of

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
JOBS, SQL = entry.queries(), entry.oracle_sql()

# One or more of every family. ALL_QUERIES=1 runs the whole book, as check.py does.
SAMPLE = (
    "s01 s06 s08 s09 p01 p02 p03 p06 p07 p16 d01 d02 d04 d06 d07 j03 j04 j05 j07 j08 j10 j11 j14 a01 a03 a08 a09 a12 "
    "w01 w05 w07 w08 w10 w11 w17 t03 u02 u04 u05 c02 c03 c04 c08 c11 c17 c22 c24 c25 c35 c43 c44 c46 q01 q02 q03 q05 q06 q07 "
    "q10 v03 v07 v08 v11 v12 v13 m01 m04 e01 e04 e06 e08 e09 e11 e13 e14 e15 e17 r01 r02 r06_sample x02 x03 x07 h02 h04 s03 s05 e08_pvalue"
).split()
CHECKED = sorted(SQL) if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, con, name):
    df = JOBS[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(SQL[name])
    assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(JOBS)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["date", "region", "n_events", "n_accounts", "gross_amount", "net_amount"] and df.count() > 0


@pytest.mark.parametrize("name", ["a01", "c03", "c06", "c08", "c22", "c24", "c43", "d01", "j03", "j07", "v03", "v08"])
def test_plan_has_no_cartesian_product(spark, name):
    plan = JOBS[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def plan_of(spark, name):
    return JOBS[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_latest_row_is_limited_before_the_shuffle(spark):
    for name in ("d01", "c52", "t03", "j08"):
        assert re.search(r"WindowGroupLimit.*Partial", plan_of(spark, name)), name


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(spark, "c05")
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string>" in plan


def test_lines_are_scanned_once(spark):
    for name in ("j03", "c01"):
        plan = plan_of(spark, name)
        assert len(re.findall(r"FileScan parquet[^\n]*lineitem", plan)) == 1 and len(re.findall(r"FileScan parquet[^\n]*orders", plan)) == 1, name


def test_sums_are_partial_before_the_shuffle(spark):
    for name in ("a02", "c01", "c07", "c15"):
        assert "partial_sum" in plan_of(spark, name), name
