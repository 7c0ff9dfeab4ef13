"""Connected components of an edge list that no task and no driver needs to hold."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.runtime import stage


class UnionFind:
    """Disjoint sets whose root is the smallest member."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = parent.setdefault(x, x)
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _local_forest(edges: DataFrame) -> DataFrame:
    """The edges of each partition as stars around the partition's own roots: at most one per node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, kind = UnionFind(), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sets.union(a, b)
        if kind is not None:
            pairs = [(x, sets.find(x)) for x in list(sets.parent)]
            pairs = [(x, r) for x, r in pairs if x != r]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], kind), pa.array([r for _, r in pairs], kind)], names=["a", "b"])

    return edges.mapInArrow(run, edges.schema)


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Large star (``both_ways``) or small star of edges a > b.

    The minimum per node is aggregated with partial sums and staged, so that the join back to the
    edges of a hub is one that adaptive execution can split.
    """
    seen = edges.select("a", "b")
    if both_ways:
        seen = seen.union(edges.select("b", "a"))
    low = seen.groupBy("a").agg(F.min("b").alias("m"))
    low = stage(low.select("a", F.least("a", "m").alias("m")))
    met = seen.join(low, "a")
    if both_ways:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.union(low.where("a != m").select("a", F.col("m").alias("b")))
    return stage(out.where("a != b").distinct())


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node is either the centre of a star or has one edge, to its centre."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("centre"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("centre").alias("centre"))
    return seen.where("out > 1 OR out = 1 AND centre = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of edges ``a``, ``b``.

    Union-find inside the partitions first, then large and small stars in turn until only stars are
    left: a number of rounds that grows with the logarithm of the longest path. NULL ends and
    loops are ignored; a node without other edges is not returned.
    """
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b")
    clean = clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stage(_local_forest(clean))
    while not _only_stars(now):
        now = _stars(_stars(now, True), False)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
