"""One record per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per key.

    Spark limits each map task to ``n`` rows per key before the shuffle (partial
    WindowGroupLimit), so a hot key sends at most ``n`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_n_per_group(df, keys, order, 1)


def latest_by(df: DataFrame, keys: list[str], sequence: str, *tie_breaks: str) -> DataFrame:
    """Row with the greatest sequence per key; further columns settle ties, greatest first."""
    return first_by(df, keys, [F.col(c).desc_nulls_last() for c in (sequence, *tie_breaks)])


def dedup_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct keys and removed duplicates from one pre-aggregated pass."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_rows"), F.count(F.lit(1)).alias("unique_keys")
    ).withColumn("duplicates_removed", F.col("input_rows") - F.col("unique_keys"))
