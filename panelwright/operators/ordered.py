"""Ordered computations over whole tables or hot keys without a one-task window.

A window over everything, or over a key that holds a third of all rows, runs in one
task. Here the rows are range-partitioned by the full order instead and written as a
stage table with their position; per-partition totals (one row per partition) then
carry counts and sums across partition borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelwright.operators.passes import Walk, ordered_pass
from panelwright.runtime import stage

_POSITION_BITS = 33  # monotonically_increasing_id: partition in the upper bits, row in the lower 33


def range_layout(df: DataFrame, order: list[Column]) -> DataFrame:
    """Stage table sorted by ``order`` with ``_part`` and the row's position ``_pos`` (from 1) in it.

    ``order`` must be unique over rows; NULLs sort first.
    """
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = stage(laid.withColumn("_id", F.monotonically_increasing_id()))
    return laid.select(
        *df.columns,
        F.shiftright("_id", _POSITION_BITS).cast("int").alias("_part"),
        F.col("_id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias("_pos0"),
    ).withColumn("_pos", F.col("_pos0") + 1).drop("_pos0")


def _part_offsets(laid: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Per partition the totals of all partitions before it. One row per partition, so the
    unpartitioned window and the broadcast are bounded by the number of tasks."""
    totals = laid.groupBy("_part").agg(*[m.alias(name) for name, m in measures.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return totals.select(
        "_part",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in measures],
        *[F.sum(n).over(everything).alias(f"{n}_total") for n in measures],
    )


def global_row_number(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``row_number`` (from 1, over the whole table) and ``n_rows``."""
    laid = range_layout(df, order)
    offsets = _part_offsets(laid, {"n": F.count(F.lit(1))})
    return laid.join(F.broadcast(offsets), "_part").select(
        *df.columns,
        (F.col("_pos") + F.col("n_before")).alias("row_number"),
        F.col("n_total").alias("n_rows"),
    )


def ntile_of(row_number: Column, n_rows: Column, tiles: int) -> Column:
    """NTILE from a row number: the first ``n_rows % tiles`` tiles hold one row more."""
    size = F.floor(n_rows / F.lit(tiles))
    large = n_rows % tiles
    edge = large * (size + 1)
    return (
        F.when(row_number <= edge, F.floor((row_number - 1) / (size + 1)))
        .otherwise(large + F.floor((row_number - 1 - edge) / F.greatest(size, F.lit(1))))
        .cast("int")
        + 1
    )


def global_ntile(df: DataFrame, order: list[Column], tiles: int, name: str) -> DataFrame:
    ranked = global_row_number(df, order)
    return ranked.withColumn(name, ntile_of(F.col("row_number"), F.col("n_rows"), tiles)).drop(
        "row_number", "n_rows"
    )


def running_total(df: DataFrame, value: str, order: list[Column]) -> DataFrame:
    """Running sum of ``value`` in the unique order ``order``, plus the grand total."""
    laid = range_layout(df, order)
    offsets = _part_offsets(laid, {"v": F.sum(value)})
    local = F.sum(value).over(
        Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        laid.withColumn("_local", local)
        .join(F.broadcast(offsets), "_part")
        .select(*df.columns, (F.col("_local") + F.col("v_before")).alias("running"), F.col("v_total").alias("total"))
    )


GRID = 256  # steps of the sketch that is taken of what a bracket holds
ACCURACY = 4096


def exact_percentiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles (as PERCENTILE_CONT) per key, NULL values ignored.

    Distributed selection. Each order statistic that is wanted has a bracket of values. A round is one scan that counts what
    lies below and inside the bracket and sketches the inside; ranks of a sketch are off by at most 1/``ACCURACY`` of what it
    has seen, so the steps around the wanted rank are the next bracket, which holds about a hundredth of the last. The ends of a
    bracket are counted apart, so each round leaves fewer values however often one repeats. It ends when a bracket is one value. Nothing is sorted, and a key of all rows is as good as many.
    """
    if not keys:
        return exact_percentiles(df.withColumn("_all", F.lit(1)), ["_all"], value, quantiles).drop("_all")
    data = stage(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")))
    grid = [k / GRID for k in range(GRID + 1)]
    wanted = {f"_{name}_{side}": (F.floor if side == "lo" else F.ceil)((F.col("_n") - 1) * F.lit(float(q))) for name, q in quantiles.items() for side in ("lo", "hi")}

    def bracket(t: str, sketch: Column, below: Column, inside: Column) -> list[Column]:
        step = F.floor((wanted[t] - below + 0.5) / F.greatest(inside, F.lit(1)) * GRID).cast("int")
        return [F.try_element_at(sketch, F.greatest(step, F.lit(1))).alias(f"{t}_from"), F.try_element_at(sketch, F.least(step + 3, F.lit(GRID + 1))).alias(f"{t}_to")]

    whole = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", grid, ACCURACY).alias("_g"))
    now = stage(whole.select(*keys, "_n", *[c for t in wanted for c in bracket(t, F.col("_g"), F.lit(0), F.col("_n"))]))
    def unsettled(rows: DataFrame) -> bool:
        return not rows.where(F.exists(F.array(*[F.col(f"{t}_from") < F.col(f"{t}_to") for t in wanted]), lambda x: x)).isEmpty()

    while unsettled(now):
        same = [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
        met = data.alias("d").join(now.alias("s"), same).select(*[F.col(f"d.{k}").alias(k) for k in keys], "_v", *[c for c in now.columns if c not in keys])
        seen = [F.first("_n").alias("_n")]
        for t in wanted:
            low, high, v = F.col(f"{t}_from"), F.col(f"{t}_to"), F.col("_v")
            between = (v > low) & (v < high)
            seen += [F.first(low).alias(f"{t}_from"), F.first(high).alias(f"{t}_to"), F.count(F.when(v < low, 1)).alias(f"{t}_below")]
            seen += [F.count(F.when(v == low, 1)).alias(f"{t}_low"), F.count(F.when(between, 1)).alias(f"{t}_between"), F.count(F.when(v <= high, 1)).alias(f"{t}_upto")]
            seen.append(F.percentile_approx(F.when(between, v), grid, ACCURACY).alias(f"{t}_g"))
        counted = met.groupBy(*keys).agg(*seen)
        columns = []
        for t in wanted:
            low, high, below, at_low, inside, upto = (F.col(f"{t}_{c}") for c in ("from", "to", "below", "low", "between", "upto"))
            held = (below <= wanted[t]) & (wanted[t] < upto)
            checked = F.when(held, below).otherwise(F.raise_error(F.lit("a sketch is less accurate than it promises")).cast("long"))
            is_low, is_high = wanted[t] < checked + at_low, wanted[t] >= checked + at_low + inside
            start, end = bracket(t, F.col(f"{t}_g"), checked + at_low, inside)  # of what lies between the ends
            columns.append(F.when(is_low, low).when(is_high, high).otherwise(start).alias(f"{t}_from"))
            columns.append(F.when(is_low, low).when(is_high, high).otherwise(end).alias(f"{t}_to"))
        now = stage(counted.select(*keys, "_n", *columns))
    out = []
    for name, q in quantiles.items():
        rank = (F.col("_n") - 1) * F.lit(float(q))
        low, high = F.col(f"_{name}_lo_from"), F.col(f"_{name}_hi_from")
        out.append((low + (high - low) * (rank - F.floor(rank))).alias(name))
    return now.select(*keys, *out)


def row_number_by_key(df: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """ROW_NUMBER per key where one key may hold a large share of the rows."""
    return ordered_pass(df, Walk([key]), order).withColumnRenamed("row_number", name)


def lag_by_key(df: DataFrame, key: str, order: list[Column], value: str, name: str) -> DataFrame:
    """LAG(value) per key where one key may hold a large share of the rows."""
    return ordered_pass(df, Walk([key], previous=[value]), order).select(*df.columns, F.col(f"previous_{value}").alias(name))


def cumulated(df: DataFrame, value: str, order: list[Column]) -> DataFrame:
    """``running`` sum of ``value`` in the unique order ``order`` and the grand ``total``, in one pass over the sorted rows."""
    passed = ordered_pass(df, Walk([], sums=[value], totals=True), order)
    return passed.select(*df.columns, F.col(f"running_{value}").alias("running"), F.col(f"total_{value}").alias("total"))
