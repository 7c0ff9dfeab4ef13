"""Ordered operators against brute force, with one key holding most rows."""

import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow.compute as pc
import pytest
from helpers import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.operators import ordered, passes, sessions


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}", rng.randrange(300), i) for i in range(5000)]
    return spark.createDataFrame(data, "k string, v long, i long").repartition(7).cache()


@pytest.fixture(params=[1, 8], ids=["one partition", "eight partitions"])
def partitions(spark, request):
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep the borders
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")




def order():
    return [F.col("v"), F.col("i")]


def test_layout_really_splits(spark, skewed, partitions):
    laid = ordered.range_layout(skewed, [F.col("k"), *order()])
    assert laid.select("_part").distinct().count() == partitions
    if partitions > 1:  # the hot key spans several partitions
        assert laid.where("k = 'hot'").select("_part").distinct().count() > 2


def test_global_row_number(spark, skewed, partitions):
    want = skewed.withColumn("row_number", F.row_number().over(Window.orderBy("v", "i")).cast("long")).withColumn("n_rows", F.lit(5000))
    assert rows(ordered.global_row_number(skewed, order())) == rows(want)


@pytest.mark.parametrize("tiles", [4, 7, 10])
def test_ntile(spark, skewed, partitions, tiles):
    want = skewed.withColumn("t", F.ntile(tiles).over(Window.orderBy("v", "i")))
    assert rows(ordered.global_ntile(skewed, order(), tiles, "t")) == rows(want)


def test_ntile_of_fewer_rows_than_tiles(spark):
    few = spark.createDataFrame([(1,), (2,), (3,)], "v int")
    assert rows(ordered.global_ntile(few, [F.col("v")], 10, "t")) == [(1, 1), (2, 2), (3, 3)]


def test_running_total(spark, skewed, partitions):
    window = Window.orderBy("v", "i").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.withColumn("running", F.sum("v").over(window)).withColumn("total", F.sum("v").over(Window.partitionBy()))
    assert rows(ordered.running_total(skewed, "v", order())) == rows(want)


def test_row_number_and_lag_by_hot_key(spark, skewed, partitions):
    window = Window.partitionBy("k").orderBy("v", "i")
    assert rows(ordered.row_number_by_key(skewed, "k", order(), "rn")) == rows(
        skewed.withColumn("rn", F.row_number().over(window).cast("long"))
    )
    assert rows(ordered.lag_by_key(skewed, "k", order(), "v", "p")) == rows(skewed.withColumn("p", F.lag("v").over(window)))


def test_percentiles_per_key(spark, skewed, partitions):
    holes = skewed.withColumn("v", F.when(F.col("v") % 10 != 0, F.col("v").cast("double")))
    got = ordered.exact_percentiles(holes, ["k"], "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99})
    values = {}
    for r in holes.where("v is not null").collect():
        values.setdefault(r.k, []).append(r.v)
    for r in got.collect():
        assert np.allclose([r.a, r.b, r.c, r.d], np.quantile(values[r.k], [0, 0.25, 0.5, 0.99]))
    assert got.count() == len(values)


def test_percentiles_of_one_hot_key(spark, monkeypatch):
    monkeypatch.setattr(ordered, "GRID", 8)  # brackets stay wide: several rounds
    monkeypatch.setattr(ordered, "ACCURACY", 60)
    rng = random.Random(3)
    values = [rng.choice([1e-300, 0.1, 0.3, -5.5, 1e200, float(rng.randrange(9)), rng.gauss(0, 1)]) for _ in range(30_000)]
    df = spark.createDataFrame([(None, v) for v in values] + [("b", 2.0), ("c", None)], "k string, v double").repartition(9)
    got = {r.k: r for r in ordered.exact_percentiles(df, ["k"], "v", {"a": 0.0, "b": 0.31, "c": 0.5, "d": 1.0}).collect()}
    assert set(got) == {None, "b"} and tuple(got["b"])[1:] == (2.0,) * 4
    assert np.allclose(tuple(got[None])[1:], np.quantile(values, [0, 0.31, 0.5, 1]), rtol=1e-14)


def test_overall_percentile(spark, skewed):
    got = ordered.exact_percentiles(skewed, [], "v", {"m": 0.5}).collect()
    assert [tuple(r) for r in got] == [(float(np.median([r.v for r in skewed.collect()])),)]


def test_sessions_of_a_hot_user(spark, partitions):
    rng = random.Random(2)
    start, data = datetime(2024, 1, 1), []
    for i in range(3000):
        data.append(("hot" if i % 3 else f"u{i % 11}", start + timedelta(seconds=rng.randrange(0, 86400 * 30)), i))
    df = spark.createDataFrame(data, "u string, ts timestamp, i long")
    want, last, number = [], {}, {}
    for u, ts, i in sorted(data):
        fresh = u not in last or (ts - last[u]).total_seconds() > 1800
        number[u] = number.get(u, 0) + fresh
        last[u] = ts
        want.append((i, int(fresh), number[u]))
    got = rows(sessions.sessionize(df, "u", "ts", "i", 1800), "i", "new_session", "session_id")
    assert got == sorted(want)


def test_one_pass_within_hot_keys(spark, skewed, partitions):
    holes = skewed.withColumn("k", F.when(F.col("k") != "k3", F.col("k"))).withColumn("v", F.when(F.col("v") % 7 != 0, F.col("v")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "90")  # keys go on from batch to batch
    walk = passes.Walk(["k"], previous=["v"], sums=["i"], opens=lambda a, b: pc.fill_null(pc.not_equal(a["v"], b["v"]), False).to_numpy(zero_copy_only=False), opens_on=["v"])
    got = passes.ordered_pass(holes, walk, order())
    window = Window.partitionBy("k").orderBy("v", "i")
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    want = (
        holes.withColumn("row_number", F.row_number().over(window).cast("long"))
        .withColumn("previous_v", F.lag("v").over(window))
        .withColumn("running_i", F.sum("i").over(upto))
        .withColumn("opened", F.when((F.col("row_number") == 1) | (F.col("previous_v") != F.col("v")), 1).otherwise(0))
        .withColumn("group_number", F.sum("opened").over(upto))
    )
    assert rows(got) == rows(want)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_pass_without_keys_and_of_nothing(spark, skewed, partitions):
    got = ordered.cumulated(skewed, "v", order())
    assert rows(got) == rows(ordered.running_total(skewed, "v", order()))
    got = passes.ordered_pass(skewed, passes.Walk([], sums=["v"]), order())
    window = Window.orderBy("v", "i").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.withColumn("row_number", F.row_number().over(Window.orderBy("v", "i")).cast("long")).withColumn("running_v", F.sum("v").over(window))
    assert rows(got) == rows(want)
    assert passes.ordered_pass(skewed.where("i < 0"), passes.Walk(["k"], previous=["v"]), order()).count() == 0


def test_one_pass_reads_its_layout_once(spark, skewed):
    plan = passes.ordered_pass(skewed, passes.Walk(["k"], previous=["v"], sums=["i"]), order())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange hash" not in plan and "Exchange range" not in plan
