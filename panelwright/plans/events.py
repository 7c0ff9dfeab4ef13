"""Event-log rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.cleaning import signed_amount, valid_account
from panelwright.operators.latest import latest_by


def clean_events(raw: DataFrame) -> DataFrame:
    """Latest ingest per event, then valid accounts only, with the signed amount.

    The account filter stays behind the choice: a correction may change the account.
    """
    return (
        latest_by(raw, ["event_id"], "ingest_seq")
        .where(valid_account(F.col("account_id")))
        .withColumn("signed_amount", signed_amount(F.col("amount"), F.col("is_reversal")))
    )


def daily_region_summary(clean: DataFrame, exact: bool = True) -> DataFrame:
    """Events, accounts, gross and net per day and region; ``exact=False`` estimates the accounts."""
    accounts = F.countDistinct("account_id") if exact else F.approx_count_distinct("account_id")
    return (
        clean.groupBy("date", "region")
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            accounts.alias("n_accounts"),
            F.round(F.sum("amount"), 2).alias("gross_amount"),
            F.round(F.sum("signed_amount"), 2).alias("net_amount"),
        )
        .orderBy("date", "region")
    )


def account_summary(clean: DataFrame) -> DataFrame:
    return clean.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.round(F.sum("signed_amount"), 2).alias("net_amount")
    )


def event_quality(raw: DataFrame) -> DataFrame:
    """Load counts from one scan and one shuffle by event id."""
    per_event = raw.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("account_id", "ingest_seq").alias("account_id")
    )
    valid = valid_account(F.col("account_id"))
    return per_event.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_rows"),
        F.count(F.lit(1)).alias("unique_event_ids"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates_removed"),
        F.count(F.when(~valid, 1)).alias("invalid_excluded"),
        F.count(F.when(valid, 1)).alias("clean_rows"),
    )
