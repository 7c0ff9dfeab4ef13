from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import topk


def brute(rows, k=5, scale=256):
    """(query, rank, id, score) by all products in Python integers."""
    kept = []
    for n, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((n, i, [max(-(1 << 63), min((1 << 63) - 1, math.floor(scale * x))) for x in v]))
    out = []
    for n, i, q in kept:
        if i is not None and i % 50 == 0:
            found = []
            for m, j, p in kept:
                if m != n and len(p) == len(q):
                    score = sum(a * b for a, b in zip(p, q, strict=True))
                    found.append((-max(-(1 << 63) + 1, min((1 << 63) - 1, score)), j is None, j or 0))
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def got(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 7, 1) for i, v in rows], "vec_id long, embedding array<double>, row long, bucket int").repartition(3)
    found = topk.top_k(df, "vec_id", "embedding", F.col("id") % 50 == 0, **how)
    assert dict(found.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    return sorted([tuple(r) for r in found.collect()], key=str)


@pytest.fixture(params=["one cell", "many cells"])
def cells(request, monkeypatch):
    if request.param == "many cells":
        monkeypatch.setattr(topk, "BUCKET", 64)
        monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
        monkeypatch.setattr(topk, "PART", 16)


def test_lengths_of_many_sizes_and_close_directions(spark, cells):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(k, ((centres[k % 6] + rng.normal(size=8) * [0.01, 1][k % 2]) * rng.lognormal(0, 1)).tolist()) for k in range(500)]
    rows += [(1000 + k, [float(x) for x in centres[0] * 4]) for k in range(300)]  # many equal rows
    rows += [(1300, [0.0] * 8), (1350, [-5.0] * 8), (1301, [0.0] * 8)]
    assert got(spark, rows) == brute(rows)


def test_nulls_sizes_and_repeated_ids(spark, cells):
    rng = random.Random(2)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(3)]) for k in range(120)]
    rows += [(None, [1.0, 1.0, 1.0]), (None, None), (100, None), (150, [None, 1.0, 2.0]), (200, [math.nan, 0.0, 0.0]), (250, [math.inf, 0.0, 0.0])]
    rows += [(0, [0.5, 0.5, 0.5]), (0, [0.5, 0.5, 0.5]), (300, [1.0, 2.0]), (301, [2.0, 1.0]), (350, []), (351, []), (400, [1.0])]
    assert got(spark, rows) == brute(rows)


def test_components_that_a_double_can_not_hold(spark, cells):
    rng = random.Random(3)
    rows = [(k, [rng.choice([1e12, 3.0, 1e15 + rng.randrange(9), -1e17, 1e30]) for _ in range(4)]) for k in range(60)]
    assert got(spark, rows) == brute(rows)


def test_coordinates_are_used_and_lose_nothing():
    rng = np.random.default_rng(4)
    vectors = np.floor(256 * rng.normal(size=(topk.PART, 16))).astype(np.int64)
    length = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-length)
    part = topk.Part(vectors[order], length[order], np.arange(topk.PART), np.ones(topk.PART, bool), np.arange(topk.PART))
    queries = (part.vectors[:50] + rng.integers(-40, 40, (50, 16))).astype(float)
    norm = np.sqrt((queries**2).sum(axis=1))
    cosine = np.full(50, 0.9)
    looked = {}
    for found, best in part.by_coordinates(queries, np.full(50, -1), norm, cosine, topk.PART):
        for q, line in zip(found, best.row, strict=True):
            looked[q] = set(line[line >= 0].tolist())
    products = queries @ part.vectors.T
    for q in range(50):
        close = set(np.flatnonzero(products[q] >= 0.9 * norm[q] * part.length).tolist())
        assert close <= looked[q] and len(looked[q]) < topk.PART / 4


def test_empty_and_few(spark):
    assert got(spark, []) == []
    assert got(spark, [(50, [1.0])]) == []
    assert got(spark, [(50, [1.0]), (51, [1.0])], k=3) == [(50, 1, 51, 65536)]
