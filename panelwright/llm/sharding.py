"""Shards of near equal bytes: best-fit-decreasing bin packing of indivisible groups.

Documents of equal text form a group that stays in one shard. Groups are packed largest first,
each into the bin with the least remaining capacity that holds it, found in a balanced tree.
Equal sizes are packed together: once the tightest bin has taken one group it stays the tightest
until it is full, so the packing of a size is a few (bin, count) runs. Spark therefore sends the
driver only a histogram of group sizes, whose number of classes has a fixed bound
(``SIGNIFICANT_BITS``: sizes are exact up to 4,096 and rounded up by less than 1/2,048 above), and
turns the runs back into shards by the position of each group in the order of sizes.

A group larger than a shard's fair share can not stay whole if shards are to be equal: it is cut
into pieces of about 1/16 of a share. There are fewer such groups than shards. They, and groups with
more than 1/256 of all rows, are found again by broadcast, so no task gathers a large group.

Defined results: a NULL text has size 8 and forms a group of its own beside empty texts; repeated
rows and NULL ids are placed each; an empty table gives an empty result; further columns are not
read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import crc32_text, picked
from panelwright.operators.ordered import global_row_number
from panelwright.runtime import stage

SIGNIFICANT_BITS = 12
PIECES_PER_SHARE = 16
HOT_ROWS = 256
STEPS = 14


class _Node:
    __slots__ = ("key", "left", "priority", "right")

    def __init__(self, key: tuple[int, int], priority: float) -> None:
        self.key, self.priority, self.left, self.right = key, priority, None, None


class BinTree:
    """Treap of (remaining capacity, bin): insert, remove and best fit in logarithmic time."""

    def __init__(self) -> None:
        self._root: _Node | None = None
        self._random = random.Random(0)

    def _split(self, node: _Node | None, key: tuple[int, int]) -> tuple[_Node | None, _Node | None]:
        if node is None:
            return None, None
        if node.key < key:
            node.right, right = self._split(node.right, key)
            return node, right
        left, node.left = self._split(node.left, key)
        return left, node

    def _merge(self, a: _Node | None, b: _Node | None) -> _Node | None:
        if a is None or b is None:
            return a or b
        if a.priority > b.priority:
            a.right = self._merge(a.right, b)
            return a
        b.left = self._merge(a, b.left)
        return b

    def insert(self, key: tuple[int, int]) -> None:
        left, right = self._split(self._root, key)
        self._root = self._merge(self._merge(left, _Node(key, self._random.random())), right)

    def remove(self, key: tuple[int, int]) -> None:
        left, rest = self._split(self._root, key)
        _, right = self._split(rest, (key[0], key[1] + 1))
        self._root = self._merge(left, right)

    def best_fit(self, size: int) -> tuple[int, int] | None:
        """The bin with the least remaining capacity of at least ``size``."""
        node, best = self._root, None
        while node is not None:
            if node.key[0] >= size:
                best, node = node.key, node.left
            else:
                node = node.right
        return best


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[list[tuple[int, int]]] | None:
    """Per (size, count), given largest first, its runs (bin, count); None if more than ``most`` bins are needed."""
    tree, bins, out = BinTree(), 0, []
    for size, count in sizes:
        runs = []
        while count:
            found = tree.best_fit(size)
            if found is None:
                if bins == most or size > capacity:
                    return None
                found = (capacity, bins)
                bins += 1
            else:
                tree.remove(found)
            room, at = found
            taken = min(count, room // size)
            runs.append((at, taken))
            count -= taken
            tree.insert((room - taken * size, at))
        out.append(runs)
    return out


def smallest_capacity(sizes: list[tuple[int, int]], shards: int) -> int:
    """Least capacity, to 1/2^14, with which the packing needs at most ``shards`` bins."""
    total = sum(s * n for s, n in sizes)
    low = max(-(-total // shards), max((s for s, _ in sizes), default=1), 1)
    if best_fit_decreasing(sizes, low, shards) is not None:
        return low
    high = 2 * low  # always enough: all bins but one would be more than half full
    for _ in range(STEPS):
        middle = (low + high) // 2
        if best_fit_decreasing(sizes, middle, shards) is None:
            low = middle
        else:
            high = middle
    return high


def _class(column: str):
    """The size rounded up to ``SIGNIFICANT_BITS`` binary digits."""
    shift = F.greatest(F.length(F.bin(column)) - SIGNIFICANT_BITS, F.lit(0))
    unit = F.expr("shiftleft(1L, _shift)")
    return shift, unit


def _with_class(df: DataFrame, column: str) -> DataFrame:
    shift, unit = _class(column)
    return df.withColumn("_shift", shift).withColumn("_class", F.ceil(F.col(column) / unit).cast("long") * unit).drop("_shift")


def _bins_by_position(groups: DataFrame, ends: list[int], bins: list[int]) -> DataFrame:
    """Adds ``shard``: the run that holds the group's position in the order of sizes."""
    sent = groups.sparkSession.sparkContext.broadcast((ends, bins))
    ranked = global_row_number(groups, [F.col("_class").desc(), F.col("key"), F.col("size")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        last, at = (np.array(x, np.int64) for x in sent.value)
        for batch in batches:
            found = np.searchsorted(last, batch["row_number"].to_numpy(), side="left")
            yield batch[["key", "size"]].assign(shard=at[found].astype("int32"))

    return ranked.select("key", "size", "row_number").mapInPandas(run, "key binary, size long, shard int")


def sharded(docs: DataFrame, shards: int) -> DataFrame:
    """Per document ``doc_id``, ``size``, ``text_crc32``, ``shard`` and its ``slot`` in the shard."""
    rows = picked(docs, doc_id="doc_id", text="text")
    text = F.col("text").cast("binary")
    items = stage(
        rows.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            crc32_text(F.col("text")).alias("text_crc32"),
            F.coalesce(F.unhex(F.md5(text)), F.lit(b"")).alias("key"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    placed = _placed(items, shards)
    sizes = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, at = [], 0
    for shard in range(shards):
        starts.append(at)
        at += sizes.get(shard, 0)
    start = F.get(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("shard"))
    ranked = global_row_number(placed, [F.col("shard"), F.col("doc_id"), F.col("_row")])
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("row_number") - 1 - start).alias("slot"), "_row")


def _placed(items: DataFrame, shards: int) -> DataFrame:
    """The items with their shard; staged, as positions depend on it."""
    spark: SparkSession = items.sparkSession
    total, n_rows = items.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    share = max(-(-total // shards), 1)
    groups = stage(items.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("bytes", F.col("n") * F.col("size")))
    is_hot = (F.col("bytes") > share) | (F.col("n") * HOT_ROWS > n_rows) & (F.col("n") > 1)
    hot = [
        (r["key"], r["size"], PIECES_PER_SHARE * -(-r["bytes"] // share) if r["bytes"] > share else 1)
        for r in groups.where(is_hot).collect()  # fewer than shards + 256
    ]
    hot_schema = "key binary, size long, pieces int"
    cut = items.join(F.broadcast(spark.createDataFrame(hot, hot_schema)), ["key", "size"])
    cut = cut.withColumn("piece", F.pmod(F.xxhash64("_row"), F.col("pieces")).cast("int")).drop("pieces")
    pieces = [tuple(r) for r in cut.groupBy("key", "size", "piece").agg(F.count(F.lit(1)).alias("n")).collect()] if hot else []

    cold = stage(_with_class(groups.where(~is_hot), "bytes").select("key", "size", "_class"))
    histogram = [(r["_class"], r["n"]) for r in cold.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()]
    entries = sorted(
        [(size, n, None) for size, n in histogram] + [(size * n, 1, (key, size, piece)) for key, size, piece, n in pieces],
        key=lambda e: (-e[0], e[2] is not None, e[2] or ()),
    )
    plain = [(size, n) for size, n, _ in entries]
    packed = best_fit_decreasing(plain, smallest_capacity(plain, shards), shards)
    ends, bins, hot_bins, at = [], [], [], 0
    for (_, _, piece), runs in zip(entries, packed, strict=True):
        for shard, count in runs:
            if piece is None:
                at += count
                ends.append(at)
                bins.append(shard)
            else:
                hot_bins.append((*piece, shard))
    out = items.join(_bins_by_position(cold, ends, bins), ["key", "size"])
    if hot:
        known = spark.createDataFrame(hot_bins, "key binary, size long, piece int, shard int")
        out = out.unionByName(cut.join(F.broadcast(known), ["key", "size", "piece"]).drop("piece"))
    return stage(out)


def digest(placed: DataFrame) -> DataFrame:
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
