"""Forecasts per origin: four baselines as plain aggregates, and rows of other models read from outside.

Ledger columns: ``target, cutoff_idx, origin_idx, target_idx, horizon, model, forecast, sigma,
runtime_s, status``.
"""

from __future__ import annotations

import time
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelwright.operators.contracts import require_columns
from panelwright.plans.supervised import Supervised
from panelwright.runtime import stage
from panelwright.sources.tables import read_shards

KEY = ["target", "cutoff_idx", "origin_idx"]
FORECAST_SCHEMA = (
    "target string, cutoff_idx int, origin_idx int, target_idx int, horizon int, model string, "
    "forecast double, sigma double, runtime_s double, status string"
)
FORECAST_COLUMNS = [part.split()[0] for part in FORECAST_SCHEMA.split(", ")]
BASELINES = ("mean", "naive_last", "naive_drift", "seasonal_naive")
SEASON = 12


def _floored(sd: Column, n: Column) -> Column:
    return F.when(n < 3, 1.0).otherwise(F.greatest(sd, F.lit(1e-8)))


def baseline_forecasts(data: Supervised, models: tuple[str, ...] = BASELINES) -> DataFrame:
    """Mean, last value, drift and seasonal last value from one grouping per origin."""
    history = data.selected_rows.where(F.col("y").isNotNull())
    series = Window.partitionBy(*KEY[:2]).orderBy("month_idx")  # one origin's months
    whole = Window.partitionBy(*KEY[:2])
    ranked = history.select(
        *KEY, "month_idx", "y", *[f"ready_{h}" for h in data.protocol.horizons],
        (F.row_number().over(series) - 1).alias("i"),
        F.count("y").over(whole).alias("n"),
        (F.col("y") - F.lag("y", 1).over(series)).alias("d1"),
        (F.col("y") - F.lag("y", SEASON).over(series)).alias("d12"),
    )

    def season_index(h: int) -> Column:
        start = F.greatest(F.col("n") - SEASON + (h - 1) % SEASON, F.lit(0))
        return F.when(F.col("n") >= SEASON, start).otherwise(F.col("n") - 1)

    stats = ranked.groupBy(*KEY).agg(
        F.max("n").alias("n"),
        F.avg("y").alias("mean"),
        F.stddev_samp("y").alias("sd"),
        F.min_by("y", "month_idx").alias("first"),
        F.max_by("y", "month_idx").alias("last"),
        F.count("d1").alias("n1"),
        F.stddev_samp("d1").alias("sd1"),
        F.count("d12").alias("n12"),
        F.stddev_samp("d12").alias("sd12"),
        *[F.max(F.when(F.col("i") == season_index(h), F.col("y"))).alias(f"season_{h}") for h in data.protocol.horizons],
        *[F.first(f"ready_{h}").alias(f"ready_{h}") for h in data.protocol.horizons],
    )
    step = _floored(F.col("sd1"), F.col("n1"))
    yearly = F.when(F.col("n12") > 0, _floored(F.col("sd12"), F.col("n12"))).otherwise(step)
    drift = (F.col("last") - F.col("first")) / F.greatest(F.col("n") - 1, F.lit(1))
    rows = []
    for h in data.protocol.horizons:
        widen = float(np.sqrt(h))
        made = {
            "mean": (F.col("mean"), _floored(F.col("sd"), F.col("n"))),
            "naive_last": (F.col("last"), step * widen),
            "naive_drift": (F.col("last") + h * drift, step * widen),
            "seasonal_naive": (F.col(f"season_{h}"), yearly),
        }
        for model in models:
            forecast, sigma = made[model]
            rows.append(
                F.struct(
                    F.lit(h).alias("horizon"), F.lit(model).alias("model"), forecast.alias("forecast"),
                    sigma.alias("sigma"), F.col(f"ready_{h}").alias("ready"),
                )
            )
    listed = stats.select(*KEY, F.explode(F.array(*rows)).alias("m")).where("m.ready")
    # Set operations over all origins at once; timed_forecasts() measures them.
    return listed.select(
        *KEY, (F.col("origin_idx") + F.col("m.horizon")).alias("target_idx"), "m.horizon", "m.model", "m.forecast",
        "m.sigma", F.lit(None).cast("double").alias("runtime_s"), F.lit("ok").alias("status"),
    ).select(*FORECAST_COLUMNS)


def timed_forecasts(data: Supervised, models: tuple[str, ...] = BASELINES) -> DataFrame:
    """Forecasts of each model from a job of its own, with the job's seconds shared out over its rows as ``runtime_s``.

    Inputs that the models share are landed before, so the first model does not pay for them.
    """
    data.selected_rows.agg(F.count(F.lit(1))).collect()
    ledgers = []
    for model in models:
        seen, began = Observation(), time.perf_counter()
        made = stage(baseline_forecasts(data, (model,)).observe(seen, F.count(F.lit(1)).alias("rows")))
        seconds = time.perf_counter() - began
        share = seconds / seen.get["rows"] if seen.get["rows"] else None
        ledgers.append(made.withColumn("runtime_s", F.lit(share).cast("double")))
    return reduce(DataFrame.unionByName, ledgers)


def read_external_forecasts(spark: SparkSession, folder: str, schema=FORECAST_SCHEMA) -> DataFrame:
    """Ledger rows produced elsewhere, as CSV shards."""
    return require_columns(read_shards(spark, folder, schema), FORECAST_COLUMNS)
