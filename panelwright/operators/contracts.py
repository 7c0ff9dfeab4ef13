"""Data contracts: every check is one row ``check, passed, n_violations``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def _verdict(name: str, violations: DataFrame) -> DataFrame:
    """``violations`` is a one-row aggregate with the column ``n_violations``."""
    n = F.coalesce(F.col("n_violations"), F.lit(0)).cast("bigint")
    return violations.select(F.lit(name).alias("check"), (n == 0).alias("passed"), n.alias("n_violations"))


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def check_unique(df: DataFrame, keys: list[str], name: str = "unique") -> DataFrame:
    """Rows beyond the first per key."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return _verdict(name, per_key.agg(F.sum(F.col("n") - 1).alias("n_violations")))


def check_columns(df: DataFrame, columns: list[str], name: str = "columns") -> DataFrame:
    """Missing columns; looks at the schema only."""
    missing = [c for c in columns if c not in df.columns]
    return _verdict(name, df.sparkSession.range(1).select(F.lit(len(missing)).alias("n_violations")))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def check_rows(df: DataFrame, violates: dict[str, Column]) -> DataFrame:
    """Several row conditions in one pass. A NULL condition is not a violation."""
    counts = df.agg(*[F.count(F.when(c, 1)).alias(f"n{i}") for i, c in enumerate(violates.values())])
    listed = F.array(
        *[F.struct(F.lit(n).alias("check"), F.col(f"n{i}").alias("n_violations")) for i, n in enumerate(violates)]
    )
    rows = counts.select(F.explode(listed).alias("r")).select("r.check", "r.n_violations")
    return rows.select("check", (F.col("n_violations") == 0).alias("passed"), "n_violations")


def check_domain(column: str, values: list) -> Column:
    """Violation of a value list; NULL is allowed."""
    return ~F.col(column).isin(values)


def check_pattern(column: str, pattern: str) -> Column:
    return ~F.coalesce(F.col(column).rlike(pattern), F.lit(False))


def check_count(df: DataFrame, expected: int | Column, name: str = "row_count") -> DataFrame:
    """Distance between the number of rows and the expected number."""
    wanted = F.lit(expected) if isinstance(expected, int) else expected
    counted = df.agg(F.count(F.lit(1)).alias("n"))
    return _verdict(name, counted.select(F.abs(F.col("n") - wanted).alias("n_violations")))


def check_distinct(df: DataFrame, column: str, expected: int | Column, name: str) -> DataFrame:
    return check_count(df.select(column).distinct(), expected, name)


def check_monotone(df: DataFrame, unit: str, time: str, state: str, name: str = "monotone") -> DataFrame:
    """Decreases of a state along time. (unit, time) is unique, so a window holds one unit's periods."""
    before = F.lag(F.coalesce(state, F.lit(0))).over(Window.partitionBy(unit).orderBy(time))
    falls = df.withColumn("_before", before).where(F.coalesce(state, F.lit(0)) < F.col("_before"))
    return _verdict(name, falls.agg(F.count(F.lit(1)).alias("n_violations")))


def cents(amount: str) -> Column:
    """Money held as a double, as the decimal it stands for. Sums of decimals are exact in any order."""
    return F.round(F.col(amount), 2).cast("decimal(28,2)")


def reconcile(a: DataFrame, total_a: Column, b: DataFrame, total_b: Column, name: str) -> DataFrame:
    """Two tables must give exactly the same total: counts, or sums of integers and decimals (:func:`cents`)."""
    totals = a.agg(total_a.alias("v")).unionAll(b.agg(total_b.alias("v")))
    if dict(totals.dtypes)["v"] in ("double", "float"):
        raise TypeError(f"{name}: sums of doubles depend on the order of rows; sum cents()")
    met = totals.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("known"))
    equal = (F.col("known") == 2) & (F.col("low") == F.col("high"))
    return _verdict(name, met.select(F.when(equal, 0).otherwise(1).alias("n_violations")))


def check_join_fanout(before: DataFrame, after: DataFrame, keys: list[str], name: str = "fanout") -> DataFrame:
    """Keys whose number of rows changed in a join."""
    b = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_before"))
    a = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_after"))
    changed = b.join(a, keys, "full").where(~F.col("n_before").eqNullSafe(F.col("n_after")))
    return _verdict(name, changed.agg(F.count(F.lit(1)).alias("n_violations")))


def ingest_quality(final: DataFrame, target: float = 0.995) -> DataFrame:
    """Success share of the final attempts against the target."""
    ok = F.coalesce(F.col("status") == 200, F.lit(False))
    return final.agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count(F.when(ok, 1)).alias("succeeded"),
        F.count(F.when(~ok, 1)).alias("failed"),
        F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("success_share"),
        (F.avg(F.when(ok, 1.0).otherwise(0.0)) >= target).alias("target_met"),
    )
