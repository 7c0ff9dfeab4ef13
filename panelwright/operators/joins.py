"""Joins that account for what they drop or multiply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.latest import first_by, top_n_per_group


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent.select(key), key, "left_anti")


def semi_filter(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is a member of ``keys``."""
    return df.join(keys.select(key), key, "left_semi")


def lateral_top_n(outer: DataFrame, inner: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """Per outer row the first ``n`` matching inner rows; outer rows without a match drop out."""
    return outer.join(top_n_per_group(inner, [key], order, n), key)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def _refuse_duplicates(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    found = duplicate_keys(df, keys).limit(1).collect()
    if found:
        raise ValueError(f"{side} side has duplicate keys, for example {found[0].asDict()}")
    return df


def join_one_to_one(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "left",
    on_dup: str = "raise",
    keep: list[Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """One-to-one join and the ledger of duplicate right keys.

    Duplicate keys on the left always fail. On the right they fail too, unless
    ``on_dup='report'``: then the first row by ``keep`` stays and the ledger names the key.
    """
    if on_dup not in ("raise", "report"):
        raise ValueError("on_dup must be 'raise' or 'report'")
    _refuse_duplicates(left, keys, "left")
    ledger = duplicate_keys(right, keys)
    if on_dup == "raise":
        _refuse_duplicates(right, keys, "right")
        unique = right
    else:
        if not keep:
            raise ValueError("on_dup='report' needs an order that settles which row stays")
        unique = first_by(right, keys, keep)
    return left.join(unique, keys, how), ledger


def merge_covariates(outcomes: DataFrame, covariates: DataFrame, keys: list[str], probe: str) -> DataFrame:
    """Left join that keeps every outcome and flags those without covariates."""
    return outcomes.join(covariates, keys, "left").withColumn(
        "missing_covariate", F.when(F.col(probe).isNull(), 1).otherwise(0)
    )


def restrict(df: DataFrame, keep: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows that meet ``keep`` and a one-row ledger ``reason, rows`` of the others (NULL included)."""
    met = F.coalesce(keep, F.lit(False))
    dropped = df.agg(F.count(F.when(~met, 1)).alias("rows")).select(F.lit(reason).alias("reason"), "rows")
    return df.where(met), dropped
