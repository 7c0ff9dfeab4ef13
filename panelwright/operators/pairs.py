"""Items bought together: exact top pairs, counted in cells of bounded size."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.runtime import stage

SEEDS = 64
BLOCK_ITEMS = 256
TASK_PAIRS = 2_000_000


def top_pairs(items: DataFrame, basket: str, item: str, n: int) -> DataFrame:
    """The ``n`` item pairs found in most baskets: ``p1 < p2, pair_orders``, ties by (p1, p2).

    1. Pairs among the ``SEEDS`` most frequent items are counted. The n-th best of them is a lower
       bound of what a pair needs to place.
    2. Items in fewer baskets than that can not place and are left out, which is exact and takes
       with it nearly all items of a huge basket.
    3. What is left of a basket is cut into blocks of about ``BLOCK_ITEMS`` items, and pairs of blocks
       are joined, so a task sees a cell of a basket and never the basket.
    4. The number of tasks follows the number of pairs, about ``TASK_PAIRS`` each. Pairs among the
       most frequent items are known from step 1, so no pair to be counted is a hot key.
    """
    members = stage(items.select(F.col(basket).alias("b"), F.col(item).alias("p")).where("b IS NOT NULL AND p IS NOT NULL").distinct())
    frequency = stage(members.groupBy("p").agg(F.count(F.lit(1)).alias("baskets")))
    seeds = frequency.orderBy(F.desc("baskets"), "p").limit(SEEDS).select("p")
    among = members.join(F.broadcast(seeds), "p").groupBy("b").agg(F.sort_array(F.collect_list("p")).alias("held"))  # at most SEEDS items
    ahead = F.transform("held", lambda x, i: F.transform(F.slice("held", i + 2, F.size("held")), lambda y: F.struct(x.alias("p1"), y.alias("p2"))))
    counted = stage(among.select(F.explode(F.flatten(ahead)).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("c")))
    best = counted.orderBy(F.desc("c")).limit(n).agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("t"))
    needed = best.select(F.when(F.col("k") == n, F.col("t")).otherwise(1).alias("needed"))

    able = frequency.join(F.broadcast(needed), F.col("baskets") >= F.col("needed")).select("p")
    kept = stage(members.join(able, "p").select("b", "p"))
    sizes = kept.groupBy("b").agg(F.count(F.lit(1)).alias("m"))
    tasks = ceil((sizes.agg(F.sum(F.col("m") * (F.col("m") - 1) / 2)).first()[0] or 0) / TASK_PAIRS)

    def dealt_by(df: DataFrame, *keys: str) -> DataFrame:
        """Few pairs are left to adaptive execution."""
        return df.repartition(tasks, *keys) if tasks > df.sparkSession.sparkContext.defaultParallelism else df

    blocks = sizes.select("b", F.ceil(F.col("m") / BLOCK_ITEMS).cast("int").alias("blocks"))
    marked = kept.join(F.broadcast(seeds.select("p", F.lit(True).alias("seed"))), "p", "left").withColumn("seed", F.col("seed").isNotNull())
    blocked = marked.join(blocks, "b").withColumn("k", F.pmod(F.xxhash64("p"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = blocked.withColumn("other", F.explode(others))
    cells = dealt.select("b", F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"), "k", "p", "seed")
    left, right = (dealt_by(cells.where(side), "b", "i", "j") for side in ("k = i", "k = j"))
    met = left.select("b", "i", "j", F.col("p").alias("x"), F.col("seed").alias("s")).join(
        right.select("b", "i", "j", F.col("p").alias("y"), F.col("seed").alias("t")), ["b", "i", "j"]
    )
    met = met.where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))).where(~(F.col("s") & F.col("t")))
    found = dealt_by(met.select(F.least("x", "y").alias("p1"), F.greatest("x", "y").alias("p2")), "p1", "p2")
    pairs = found.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("pair_orders"))
    pairs = pairs.unionByName(counted.select("pair.p1", "pair.p2", F.col("c").alias("pair_orders")))
    return pairs.orderBy(F.desc("pair_orders"), "p1", "p2").limit(n)
