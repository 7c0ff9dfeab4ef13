"""Exact inner-product search in buckets of vectors of like length.

1. Vectors are sorted by length (per number of components) and cut into buckets of ``BUCKET`` rows, the longest
   first. Equal vectors fill buckets like any others, so no bucket is larger.
2. Every query meets the first bucket. The worst of its best ``k`` there is a threshold that a result
   must reach: from it follows how long a vector must be at least (``need``).
3. Queries are sorted by their need and cut into blocks. A block visits the buckets whose longest vector
   reaches the least need in it: a run of buckets from the first, and a bucket is visited by a run of
   blocks from the first, so both sides are dealt to cells (block, bucket) without a join.
4. A cell goes through its bucket in parts of ``PART`` rows. For each query and part the local
   threshold is the cosine that a vector of the part's greatest length needs. Above 1 the part is passed
   over. From ``COORDINATES_FROM`` on, candidates are taken from the sorted values of the query's largest coordinate: the
   angle allowed confines each coordinate to an interval. Below, products are taken of all rows that are long
   enough. Products are verified on the integers, and thresholds rise from part to part.

Bounds carry a relative slack of 1e-9 against rounding, so nothing that ties with a result is passed over.

Defined results: NULL vectors and those with a NULL or non-finite component take no part; vectors of
different numbers of components never meet, empty ones score 0; a NULL id is no query, and as a candidate the last
of its ties; rows with equal ids are rows of their own (also as queries), and further ties go by the vector's components; components and
scores beyond the range of a long are cut at its ends; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.passes import Walk, ordered_pass
from panelwright.runtime import stage

BUCKET = 8192
QUERY_BLOCK = 2048
PART = 1024
COORDINATES_FROM = 0.75
FOCUS = 3  # largest coordinates of a query that are looked at
PAIRS = 1 << 20  # candidates verified at once
EXACT = float(1 << 43)  # products below leave room in a double for a rank within the part
LEAST = -(1 << 63)
SLACK = 1e-9


@dataclass
class Best:
    """The best ``k`` of each query so far: scores (``LEAST``: none), ids, whether the id is known, rows."""

    score: np.ndarray
    id: np.ndarray
    known: np.ndarray
    row: np.ndarray

    @staticmethod
    def none(m: int, k: int) -> Best:
        return Best(np.full((m, k), LEAST), np.zeros((m, k), np.int64), np.zeros((m, k), bool), np.full((m, k), -1))

    def add(self, at: np.ndarray, more: Best) -> None:
        """Merges further results of the queries ``at``."""
        k = self.score.shape[1]
        both = [np.concatenate([getattr(self, f)[at], getattr(more, f)], axis=1) for f in ("score", "id", "known", "row")]
        order = np.lexsort((both[3], both[1], ~both[2], ~both[0]), axis=1)[:, :k]
        for f, values in zip(("score", "id", "known", "row"), both, strict=True):
            getattr(self, f)[at] = np.take_along_axis(values, order, axis=1)

    def threshold(self, floor: np.ndarray) -> np.ndarray:
        worst = self.score[:, -1]
        return np.maximum(floor, np.where(worst == LEAST, -np.inf, worst.astype(float)))


class Part:
    """Rows of like length, the longest first."""

    def __init__(self, vectors: np.ndarray, length: np.ndarray, id: np.ndarray, known: np.ndarray, row: np.ndarray) -> None:
        self.exact, self.length, self.id, self.known, self.row = vectors, length, id, known, row
        self.vectors = vectors.astype(float)
        self.rank = np.empty(len(row), np.int64)  # order of ties
        self.rank[np.lexsort((row, id, ~known))] = np.arange(len(row))
        self._by_value: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def direction(self, f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cosine to axis ``f``: by row, sorted, and the rows in that order."""
        if f not in self._by_value:
            cosine = np.divide(self.vectors[:, f], self.length, out=np.zeros(len(self.length)), where=self.length > 0)
            order = np.argsort(cosine, kind="stable")
            self._by_value[f] = cosine, cosine[order], order
        return self._by_value[f]

    def results(self, rows: np.ndarray, score: np.ndarray) -> Best:
        """Rows (``-1``: none) and their scores as results."""
        none = rows < 0
        return Best(np.where(none, LEAST, score), np.where(none, 0, self.id[rows]), np.where(none, False, self.known[rows]), np.where(none, -1, self.row[rows]))

    def by_length(self, queries: np.ndarray, own: np.ndarray, need: float, k: int) -> Best:
        """Products of all rows that are at least ``need`` long."""
        n = max(1, int(np.searchsorted(-self.length, -need, side="right")))
        products = queries @ self.vectors[:n].T
        ranked = products * PART + (PART - 1 - self.rank[:n])
        ranked[own[:, None] == self.row[None, :n]] = -np.inf
        kept = min(k, n)
        best = np.argpartition(-ranked, kept - 1, axis=1)[:, :kept]
        score = np.take_along_axis(products, best, axis=1).astype(np.int64)
        return self.results(np.where(np.isneginf(np.take_along_axis(ranked, best, axis=1)), -1, best), score)

    def by_integers(self, queries: np.ndarray, own: np.ndarray, k: int) -> Best:
        """All products in integers of any size, for components that a double can not hold."""
        products = np.clip(queries.astype(object) @ self.exact.astype(object).T, LEAST + 1, (1 << 63) - 1).astype(np.int64)
        rows, score = np.full((len(queries), k), -1), np.full((len(queries), k), LEAST)
        for q in range(len(queries)):
            order = [r for r in np.lexsort((self.rank, ~products[q])) if self.row[r] != own[q]][:k]
            rows[q, : len(order)], score[q, : len(order)] = order, products[q, order]
        return self.results(rows, score)

    def by_coordinates(self, queries: np.ndarray, own: np.ndarray, norm: np.ndarray, cosine: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, Best]]:
        """Rows whose cosine to a query can reach ``cosine``, found by the intervals of its largest coordinates."""
        towards = queries / norm[:, None]
        focus = np.argsort(-np.abs(towards), axis=1)[:, :FOCUS]
        angle = np.arccos(np.clip(cosine, -1, 1))
        beta = np.arccos(np.clip(np.take_along_axis(towards, focus, axis=1), -1, 1))
        low = np.cos(np.minimum(np.pi, beta + angle[:, None])) - SLACK
        high = np.cos(np.maximum(0, beta - angle[:, None])) + SLACK
        for f in np.unique(focus[:, 0]):
            mine = np.flatnonzero(focus[:, 0] == f)
            _, sorted_cosines, rows = self.direction(f)
            start = np.searchsorted(sorted_cosines, low[mine, 0], side="left")
            count = np.maximum(np.searchsorted(sorted_cosines, high[mine, 0], side="right") - start, 0)
            for some in _runs(count, PAIRS):
                q = np.repeat(mine[some], count[some])
                offset = np.arange(len(q)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
                p = rows[np.repeat(start[some], count[some]) + offset]
                for j in range(1, focus.shape[1]):
                    value = np.empty(len(q))
                    for g in np.unique(focus[q, j]):
                        at = focus[q, j] == g
                        value[at] = self.direction(g)[0][p[at]]
                    fits = (value >= low[q, j]) & (value <= high[q, j])
                    q, p = q[fits], p[fits]
                other = own[q] != self.row[p]
                q, p = q[other], p[other]
                score = np.einsum("ij,ij->i", queries[q], self.vectors[p]).astype(np.int64)
                order = np.lexsort((self.rank[p], ~score, q))
                q, p, score = q[order], p[order], score[order]
                first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.array([], int)
                place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
                q, p, score, place = (x[place < k] for x in (q, p, score, place))
                found, line = np.unique(q, return_inverse=True)
                table, scores = np.full((len(found), k), -1), np.full((len(found), k), LEAST)
                table[line, place], scores[line, place] = p, score
                yield found, self.results(table, scores)


def _runs(count: np.ndarray, most: int) -> Iterator[slice]:
    """Neighbouring entries whose counts sum to about ``most``."""
    upto, start = np.cumsum(count), 0
    while start < len(count):
        before = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield slice(start, end)
        start = end


def search(parts: Iterator[Part], queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> Best:
    """The best ``k`` rows of all parts for each query that reach its ``floor``."""
    best = Best.none(len(queries), k)
    real = queries.astype(float)
    norm = np.sqrt((real**2).sum(axis=1))
    for part in parts:
        longest = part.length[0]
        least = best.threshold(floor)
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(least > 0, least / norm * (1 - SLACK), -np.inf)  # a positive score needs a query longer than 0
        cosine = need / longest if longest > 0 else np.where(need > 0, np.inf, -np.inf)
        able = cosine <= 1
        if longest * norm.max(initial=0) >= EXACT:
            at = np.flatnonzero(able)
            if len(at):
                best.add(at, part.by_integers(queries[at], own[at], k))
            continue
        narrow = able & (cosine >= COORDINATES_FROM)
        at = np.flatnonzero(able & ~narrow)
        if len(at):
            best.add(at, part.by_length(real[at], own[at], float(need[at].min()), k))
        at = np.flatnonzero(narrow)
        if len(at):
            for found, more in part.by_coordinates(real[at], own[at], norm[at], cosine[at], k):
                best.add(at[found], more)
    return best


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0), np.int64)


def _cell(k: int):
    def run(_, bucket: pa.Table, block: pa.Table) -> pa.Table:
        order = np.argsort(-bucket.column("length").to_numpy(), kind="stable")
        bucket = bucket.take(pa.array(order))
        vectors, id = _matrix(bucket), bucket.column("id").combine_chunks()
        known, length, row = id.is_valid().to_numpy(zero_copy_only=False), bucket.column("length").to_numpy(), bucket.column("row").to_numpy()
        ids = id.fill_null(0).to_numpy()
        cuts = [slice(a, a + PART) for a in range(0, len(row), PART)]
        parts = (Part(vectors[c], length[c], ids[c], known[c], row[c]) for c in cuts)
        own = block.column("row").to_numpy()
        floor = block.column("floor").fill_null(-np.inf).to_numpy()
        best = search(parts, _matrix(block), own, floor, k)
        q, place = np.nonzero(best.row >= 0)
        return pa.table({
            "dim": pa.array(np.full(len(q), vectors.shape[1] if len(vectors) else 0, np.int32)), "query_row": pa.array(own[q]), "query_id": block.column("id").take(pa.array(q)), "row": pa.array(best.row[q, place]),
            "vec_id": pa.array(best.id[q, place], mask=~best.known[q, place]), "score": pa.array(best.score[q, place]),
        })

    return run


def quantized(vector: Column, scale: int) -> Column:
    """Components as ``floor(scale * x)``; NULL where a component is NULL or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def top_k(vectors: DataFrame, id: str, vector: str, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """The ``k`` highest integer products of each query row (``is_query``, on the column ``id``) with all other rows.

    Returns ``query_id``, ``rank`` (from 1, ties to the smaller id), ``vec_id``, ``score``.
    """
    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), quantized(F.col(f"`{vector}`"), scale).alias("v")).where("v IS NOT NULL")
    rows = rows.withColumn("twin", F.monotonically_increasing_id())
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    rows = rows.select("id", "v", "twin", F.size("v").alias("dim"), F.sqrt(squares).alias("length"))
    sorted_rows = ordered_pass(rows, Walk(["dim"]), [F.desc("length"), F.col("id"), F.col("v"), F.col("twin")])
    bucket = F.expr(f"(row_number - 1) div {BUCKET}")
    laid = stage(sorted_rows.select("id", "v", "dim", "length", F.col("row_number").alias("row"), bucket.alias("bucket")))
    queries = laid.where(is_query).select("id", "v", "dim", "length", "row")

    found = stage(_dealt(*_first_bucket(laid, queries), k))
    rest = _dealt(*_reached(laid, queries, found, k), k)
    window = Window.partitionBy("dim", "query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ranked = found.union(rest).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _dealt(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Every cell of a bucket's rows and a block's queries (dim, bucket, block) searched by itself."""
    by = ["dim", "bucket", "block"]
    schema = "dim int, query_row long, query_id long, row long, vec_id long, score long"
    return rows.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(_cell(k), schema)


def _blocked(queries: DataFrame, order: list[Column]) -> DataFrame:
    """Queries in blocks of ``QUERY_BLOCK`` by ``order``."""
    numbered = ordered_pass(queries, Walk(["dim"]), [*order, F.col("row")])
    return numbered.withColumn("block", F.expr(f"(row_number - 1) div {QUERY_BLOCK}")).drop("row_number")


def _first_bucket(laid: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The longest vectors with every block of queries."""
    asked = _blocked(queries.withColumn("floor", F.lit(None).cast("double")), [])
    blocks = asked.groupBy("dim").agg(F.max("block").alias("last"))
    rows = laid.where("bucket = 0").join(blocks, "dim").withColumn("block", F.explode(F.expr("sequence(0L, last)")))
    return rows, asked.withColumn("bucket", F.lit(0).cast("long"))


def _reached(laid: DataFrame, queries: DataFrame, found: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Rows and queries of the cells of further buckets that a query's threshold lets it reach.

    Runs of buckets and of blocks are counted over one row per bucket and per block.
    """
    floors = found.groupBy("dim", F.col("query_row").alias("row")).agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("worst"))
    known = queries.join(floors, ["dim", "row"], "left").withColumn("floor", F.when(F.col("n") == k, F.col("worst"))).drop("n", "worst")
    need = F.when(F.col("floor") > 0, F.col("floor") / F.col("length") * (1 - SLACK)).otherwise(-math.inf)
    asked = _blocked(known.withColumn("need", need), [F.col("need")])
    tops = laid.groupBy("dim", "bucket").agg(F.max("length").alias("at")).withColumn("block", F.lit(None).cast("long"))
    needs = asked.groupBy("dim", "block").agg(F.min("need").alias("at")).withColumn("bucket", F.lit(None).cast("long"))
    steps = tops.unionByName(needs)
    longer = Window.partitionBy("dim").orderBy(F.desc("at"), F.col("block").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    easier = Window.partitionBy("dim").orderBy(F.col("at"), F.col("bucket").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    steps = stage(steps.withColumn("buckets", F.count("bucket").over(longer)).withColumn("blocks", F.count("block").over(easier)))
    visited = steps.where("bucket > 0 AND blocks > 0").select("dim", "bucket", "blocks")
    rows = laid.join(visited, ["dim", "bucket"]).withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).drop("blocks")
    reach = steps.where("block IS NOT NULL AND buckets > 1").select("dim", "block", "buckets")
    return rows, asked.join(reach, ["dim", "block"]).withColumn("bucket", F.explode(F.expr("sequence(1L, buckets - 1)"))).drop("buckets")
