"""Calendars and spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.cleaning import month_end, month_from_index, month_index, quarter_label


def _one(spark: SparkSession) -> DataFrame:
    return spark.range(1)


def date_spine(spark: SparkSession, first: Column, last: Column) -> DataFrame:
    """One row per day from ``first`` to ``last``."""
    days = F.sequence(first.cast("date"), last.cast("date"), F.expr("INTERVAL 1 DAY"))
    return _one(spark).select(F.explode(days).alias("d"))


def month_end_vintages(spark: SparkSession, first: Column, last: Column) -> DataFrame:
    """Month ends within ``[first, last]``."""
    first, last = first.cast("date"), last.cast("date")
    months = F.sequence(month_index(first), month_index(last))
    ends = _one(spark).select(F.explode(months).alias("i")).select(month_end(month_from_index(F.col("i"))).alias("vintage_date"))
    return ends.where(F.col("vintage_date").between(first, last))


def month_spine(df: DataFrame, keys: list[str], date: str) -> DataFrame:
    """Every month from each key's first to its last, with the key's rows joined on month start.

    ``df`` has at most one row per key and month; months without a row carry NULL.
    """
    index = month_index(F.col(date))
    rows = df.withColumn("month_idx", index)
    span = rows.groupBy(*keys).agg(F.min("month_idx").alias("lo"), F.max("month_idx").alias("hi"))
    spine = span.select(*keys, F.explode(F.sequence("lo", "hi")).alias("month_idx"))
    return (
        spine.join(rows.drop(date), [*keys, "month_idx"], "left")
        .withColumn(date, month_from_index(F.col("month_idx")))
    )


def panel_spine(keys: DataFrame, key: str, first: Column, last: Column) -> DataFrame:
    """Every key in every quarter between two days. The quarter list is a literal-sized array,
    so the spine is an explode and needs neither a join nor a shuffle."""
    quarters = F.sequence(F.trunc(first, "quarter"), F.trunc(last, "quarter"), F.expr("INTERVAL 3 MONTH"))
    start = F.col("_start")
    return (
        keys.select("*", F.explode(quarters).alias("_start"))
        .withColumn("quarter", quarter_label(start))
        .withColumn("quarter_end", F.last_day(F.add_months(start, 2)))
        .drop("_start")
    )
