"""Vintage (bitemporal) tables: what was known when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelwright.functions.cleaning import month_end, month_from_index, month_index
from panelwright.operators.calendar import month_spine
from panelwright.operators.contracts import check_rows, require_columns
from panelwright.operators.latest import first_by
from panelwright.operators.series import rolling_sd, transform_series
from panelwright.runtime import stage

PANEL_COLUMNS = ["series_id", "observation_date", "vintage_date", "value"]
TRUTH_MODES = ("first_release", "latest")


def vintage_panel(df: DataFrame) -> DataFrame:
    """Typed panel ``series_id, observation_date, vintage_date, value`` without missing values."""
    require_columns(df, PANEL_COLUMNS)
    value = F.col("value").try_cast("double")
    typed = df.select(
        "series_id",
        F.col("observation_date").cast("date").alias("observation_date"),
        F.col("vintage_date").cast("date").alias("vintage_date"),
        F.when(~F.isnan(value), value).alias("value"),
    )
    return typed.where(F.col("value").isNotNull())


def vintages(panel: DataFrame) -> DataFrame:
    return panel.select("vintage_date").distinct().orderBy("vintage_date")


def _cutoff_bounds(first: str, last: str) -> tuple[Column, Column]:
    """Month indexes of the first and last month end within two days."""
    a, b = F.lit(first).cast("date"), F.lit(last).cast("date")
    return month_index(a), month_index(b) - F.when(b < month_end(b), 1).otherwise(0)


def days_of(spark: SparkSession, days: list[str]) -> DataFrame:
    """Cutoff table of given days."""
    return spark.createDataFrame([(d,) for d in days], "cutoff string").select(F.col("cutoff").cast("date").alias("cutoff"))


def month_ends(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Cutoff table of the month ends within two days."""
    lo, hi = _cutoff_bounds(first, last)
    return spark.range(1).select(F.explode(F.when(lo <= hi, F.sequence(lo, hi))).alias("m")).select(month_end(month_from_index(F.col("m"))).alias("cutoff"))


def _seen_from(intervals: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Closed intervals ``realtime_start, realtime_end`` (either may be NULL: open) with every cutoff they hold, as ``cutoff``.

    One sweep over the days that occur, as cutoff or as an end of an interval, tells how many cutoffs lie before and up to
    each. An interval's cutoffs are then a range of positions, listed without comparing it with any other. The sweep has one
    row per day of the calendar.
    """
    days = cutoffs.where("cutoff IS NOT NULL").select("cutoff").distinct()
    ends = intervals.select(F.explode(F.array("realtime_start", "realtime_end")).alias("day")).where("day IS NOT NULL").distinct()
    marks = days.select(F.col("cutoff").alias("day"), F.lit(1).alias("is_cutoff")).unionByName(ends.withColumn("is_cutoff", F.lit(0)))
    upto = Window.orderBy("day")
    places = stage(
        marks.groupBy("day").agg(F.max("is_cutoff").alias("is_cutoff")).select("day", "is_cutoff", F.sum("is_cutoff").over(upto).alias("upto"))
    )
    total = F.lit(places.agg(F.max("upto")).first()[0] or 0).cast("long")
    starts = places.select(F.col("day").alias("realtime_start"), (F.col("upto") - F.col("is_cutoff")).alias("_start"))
    finishes = places.select(F.col("day").alias("realtime_end"), F.col("upto").alias("_finish"))
    ranged = intervals.join(starts, "realtime_start", "left").join(finishes, "realtime_end", "left")
    first, after = F.coalesce("_start", F.lit(0)), F.coalesce("_finish", total)
    listed = ranged.where(first < after).withColumn("_at", F.explode(F.sequence(first + 1, after)))
    held = places.where("is_cutoff = 1").select(F.col("upto").alias("_at"), F.col("day").alias("cutoff"))
    return listed.join(held, "_at").select(*intervals.columns, "cutoff")


def snapshots_at(panel: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """What was known on each day of the table ``cutoffs`` (column ``cutoff``; any days, in any order).

    A revision is valid from its own day to the day before the next revision's.
    Output: ``cutoff, series_id, observation_date, value``.
    """
    following = F.lead("vintage_date").over(Window.partitionBy("series_id", "observation_date").orderBy("vintage_date"))
    valid = panel.select("series_id", "observation_date", "value", F.col("vintage_date").alias("realtime_start"), F.date_sub(following, 1).alias("realtime_end"))
    return _seen_from(valid, cutoffs).select("cutoff", "series_id", "observation_date", "value")


def snapshots(panel: DataFrame, first: str, last: str) -> DataFrame:
    """What every month-end cutoff saw: the latest revision known by then per series and observation.

    Each revision is valid from its own month to the month before the next revision's, so one
    pass lists its cutoffs directly. No cutoff is compared with rows it does not keep.
    Output: ``cutoff_idx, series_id, observation_date, value``.
    """
    lo, hi = _cutoff_bounds(first, last)
    following = F.lead("vintage_date").over(Window.partitionBy("series_id", "observation_date").orderBy("vintage_date"))
    start = F.greatest(month_index(F.col("vintage_date")), lo)
    end = F.least(F.coalesce(month_index(F.col("_next")) - 1, hi), hi)
    return (
        panel.withColumn("_next", following)
        .withColumns({"_from": start, "_to": end})
        .where(F.col("_from") <= F.col("_to"))
        .select(
            F.explode(F.sequence("_from", "_to")).alias("cutoff_idx"), "series_id", "observation_date", "value"
        )
    )


def observation_spans(panel: DataFrame, first: str, last: str) -> DataFrame:
    """First and last observed month of all series per cutoff: ``cutoff_idx, lo, hi``.

    The panel is reduced to one row per vintage month before the running bounds are taken.
    """
    start, end = _cutoff_bounds(first, last)
    observed = month_index(F.col("observation_date"))
    per_month = (
        panel.groupBy(F.greatest(month_index(F.col("vintage_date")), start).alias("_from"))
        .agg(F.min(observed).alias("lo"), F.max(observed).alias("hi"))
        .where(F.col("_from") <= end)
    )
    order = Window.orderBy("_from")  # one row per calendar month
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    steps = per_month.select(
        "_from",
        F.coalesce(F.lead("_from").over(order) - 1, end).alias("_to"),
        F.min("lo").over(so_far).alias("lo"),
        F.max("hi").over(so_far).alias("hi"),
    )
    return steps.select(F.explode(F.sequence("_from", "_to")).alias("cutoff_idx"), "lo", "hi")


def truths(panel: DataFrame) -> DataFrame:
    """First release and latest value of every observation: ``series_id, observation_date, truth_mode, value``."""
    both = panel.groupBy("series_id", "observation_date").agg(
        F.min_by("value", "vintage_date").alias("first_release"), F.max_by("value", "vintage_date").alias("latest")
    )
    return both.unpivot(["series_id", "observation_date"], list(TRUTH_MODES), "truth_mode", "value")


def truth(panel: DataFrame, mode: str) -> DataFrame:
    if mode not in TRUTH_MODES:
        raise ValueError(f"truth mode must be one of {TRUTH_MODES}")
    return truths(panel).where(F.col("truth_mode") == mode).drop("truth_mode")


# -- revision histories -------------------------------------------------------------------------


def initial_release(history: DataFrame) -> DataFrame:
    """First revision that carries a value."""
    valid = history.where(F.col("value").isNotNull())
    first = first_by(valid, ["series_id", "observation_date"], [F.col("realtime_start"), F.col("realtime_end")])
    return first.select("series_id", "observation_date", F.col("realtime_start").alias("vintage_date"), "value")


def snapshot_from_history(history: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Snapshots of closed validity intervals at any days (column ``cutoff``).

    At a cutoff the active interval with the latest start wins. If that one has no value the
    observation is absent: an earlier revision does not come back.
    """
    active = _seen_from(history.select("series_id", "observation_date", "realtime_start", "realtime_end", "value"), cutoffs)
    latest = active.groupBy("series_id", "observation_date", "cutoff").agg(F.max_by(F.struct("value"), "realtime_start").alias("_v"))
    return latest.where(F.col("_v.value").isNotNull()).select("series_id", "observation_date", F.col("cutoff").alias("vintage_date"), "_v.value")


def build_vintage_panel(history: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Initial releases and the snapshot of every cutoff, without repeated rows."""
    return initial_release(history).unionByName(snapshot_from_history(history, cutoffs)).dropDuplicates()


# -- truth series and regimes ---------------------------------------------------------------------


def truth_series(panel: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Transformed truth on a gap-free month spine: ``target, truth_mode, month_idx, value``."""
    raw = truths(panel.where(F.col("series_id").isin(list(kinds)))).withColumnRenamed("series_id", "target")
    spine = month_spine(raw, ["target", "truth_mode"], "observation_date")
    done = transform_series(spine, ["target", "truth_mode"], "month_idx", "value", kinds, "target", "y")
    return done.select("target", "truth_mode", "month_idx", F.col("y").alias("value"))


def regime_map(panel: DataFrame, indicator: str) -> DataFrame:
    """``month_idx, regime``: recession where the indicator's latest truth is at least 0.5."""
    latest = truth(panel.where(F.col("series_id") == indicator), "latest")
    state = F.when(F.col("value") >= 0.5, "recession").otherwise("expansion")
    return latest.select(month_index(F.col("observation_date")).alias("month_idx"), state.alias("regime"))


def volatility_regime(latest: DataFrame, length: int = 24) -> DataFrame:
    """``target, month_idx, vol_regime`` from the rolling sd of changes against its 75 % quantile.

    ``latest`` holds one row per target and month.
    """
    window = Window.partitionBy("target").orderBy("month_idx")
    change = F.col("value") - F.lag("value", 1).over(window)
    sd = latest.withColumn("_change", change).withColumn(
        "_sd", rolling_sd("_change", window, length, max(8, length // 2))
    )
    # A target has one row per calendar month, so its exact percentile is a small group.
    limits = sd.groupBy(F.col("target").alias("_t")).agg(F.percentile("_sd", F.lit(0.75)).alias("_limit"))
    state = (
        F.when(F.col("_limit").isNull(), "unknown")
        .when(F.col("_sd") >= F.col("_limit"), "high_volatility")
        .otherwise("normal_volatility")
    )
    return sd.join(limits, F.col("target") == F.col("_t")).select("target", "month_idx", state.alias("vol_regime"))


# -- audits -------------------------------------------------------------------------------------------


def data_audit(panel: DataFrame) -> DataFrame:
    """Coverage per series. Rows are first reduced to (series, observation, vintage)."""
    cells = panel.groupBy("series_id", "observation_date", "vintage_date").agg(F.count("*").alias("n"))
    return cells.groupBy("series_id").agg(
        F.sum("n").alias("rows"),
        F.countDistinct("observation_date").alias("observations"),
        F.countDistinct("vintage_date").alias("vintages"),
        F.min("observation_date").alias("first_observation"),
        F.max("observation_date").alias("last_observation"),
        F.min("vintage_date").alias("first_vintage"),
        F.max("vintage_date").alias("last_vintage"),
        F.sum(F.col("n") - 1).alias("duplicate_series_obs_vintage"),
    )


def assert_no_leakage(origins: DataFrame) -> DataFrame:
    """No origin after its cutoff, targets after origins, and origins that never move back.

    ``origins`` has one row per target, cutoff and horizon; a target's rows are bounded by the calendar.
    """
    before = F.max("origin_idx").over(
        Window.partitionBy("target", "horizon").orderBy("cutoff_idx").rowsBetween(Window.unboundedPreceding, -1)
    )
    return check_rows(
        origins.withColumn("_before", before),
        {
            "origin after cutoff": F.col("origin_idx") > F.col("cutoff_idx"),
            "label not after origin": F.col("target_idx") <= F.col("origin_idx"),
            "origin moves back": F.col("origin_idx") < F.col("_before"),
        },
    )
