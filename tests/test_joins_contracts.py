import pytest
from helpers import rows
from pyspark.sql import functions as F

from panelwright.operators import contracts as Q
from panelwright.operators import joins as J
from panelwright.operators import latest as L


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, x string")


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([(1, 9.0), (1, -1.0), (2, 5.0)], "k int, y double")


def test_one_to_one_refuses_duplicates(left, right):
    with pytest.raises(ValueError, match="right side has duplicate keys"):
        J.join_one_to_one(left, right, ["k"])
    with pytest.raises(ValueError, match="left side"):
        J.join_one_to_one(right, left, ["k"])


def test_one_to_one_reports(left, right):
    joined, ledger = J.join_one_to_one(left, right, ["k"], on_dup="report", keep=[F.abs("y")])
    assert rows(joined) == [(1, "a", -1.0), (2, "b", 5.0), (3, "c", None)]
    assert rows(ledger) == [(1, 2)]


def test_covariates_and_restrict(left, right):
    flagged = J.merge_covariates(left, right.where("y > 0"), ["k"], "y")
    assert rows(flagged, "k", "missing_covariate") == [(1, 0), (2, 0), (3, 1)]
    kept, dropped = J.restrict(flagged, F.col("y") > 6, "small")
    assert (kept.count(), rows(dropped)) == (1, [("small", 2)])


def test_latest_and_ties(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, None, "d")], "k int, s int, v string")
    assert rows(L.latest_by(df, ["k"], "s", "v"), "k", "v") == [(1, "c"), (2, "d")]
    assert rows(L.dedup_report(df, ["k"])) == [(4, 2, 2)]


def test_contracts(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 0), (2, 1, 5), (2, 1, 1)], "u int, t int, s int")
    assert rows(Q.check_unique(df, ["u", "t"])) == [("unique", False, 1)]
    assert rows(Q.check_monotone(df.where("u = 1"), "u", "t", "s")) == [("monotone", False, 1)]
    assert rows(Q.check_rows(df, {"domain": Q.check_domain("s", [0, 1])})) == [("domain", False, 1)]
    assert rows(Q.check_columns(df, ["u", "zz"])) == [("columns", False, 1)]
    assert rows(Q.check_count(df, 5)) == [("row_count", True, 0)]
    assert rows(Q.reconcile(df, F.sum("t"), df, F.sum("t"), "same")) == [("same", True, 0)]
    assert rows(Q.reconcile(df.where("u > 9"), F.sum("t"), df, F.sum("t"), "empty")) == [("empty", False, 1)]
    with pytest.raises(ValueError, match="missing columns"):
        Q.require_columns(df, ["zz"])


def test_one_cent_is_found_among_large_sums(spark):
    big = spark.createDataFrame([(9e12 + 0.01 * k,) for k in range(2000)], "m double")
    less = spark.createDataFrame([(9e12 + 0.01 * k - (0.01 if k == 700 else 0),) for k in range(2000)], "m double").repartition(5)
    assert rows(Q.reconcile(big, F.sum(Q.cents("m")), big.repartition(7), F.sum(Q.cents("m")), "same")) == [("same", True, 0)]
    assert rows(Q.reconcile(big, F.sum(Q.cents("m")), less, F.sum(Q.cents("m")), "less")) == [("less", False, 1)]
    with pytest.raises(TypeError, match="cents"):
        Q.reconcile(big, F.sum("m"), big, F.sum("m"), "doubles")


def test_empty_tables_pass(spark):
    empty = spark.createDataFrame([], "u int, t int")
    assert rows(Q.check_unique(empty, ["u"])) == [("unique", True, 0)]
