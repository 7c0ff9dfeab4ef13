import random
from collections import Counter
from itertools import combinations

import pytest
from helpers import rows

from panelwright.operators import pairs
from panelwright.operators.pairs import top_pairs


def brute(data, n):
    baskets = {}
    for b, p in data:
        if b is not None and p is not None:
            baskets.setdefault(b, set()).add(p)
    count = Counter(pair for items in baskets.values() for pair in combinations(sorted(items), 2))
    ranked = sorted(((-c, *pair) for pair, c in count.items()))[:n]
    return sorted((p1, p2, -c) for c, p1, p2 in ranked)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("block", [3, 256])
def test_pairs_are_exact(spark, seed, block, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_ITEMS", block)
    monkeypatch.setattr(pairs, "SEEDS", 5)
    rng = random.Random(seed)
    data = [(b, rng.randrange(12)) for b in range(25) for _ in range(rng.randrange(1, 9))] + [(None, 1), (3, None)]
    data += [(100 + h, p) for h in range(rng.randrange(1, 5)) for p in range(rng.randrange(6, 40))]
    df = spark.createDataFrame(data, "b long, p long")
    assert rows(top_pairs(df, "b", "p", 20)) == brute(data, 20)


def test_a_basket_of_five_thousand_items(spark):
    rng = random.Random(9)
    data = [(0, p) for p in range(5000)] + [(b, rng.randrange(300)) for b in range(1, 400) for _ in range(6)]
    df = spark.createDataFrame(data, "b long, p long")
    assert rows(top_pairs(df, "b", "p", 10)) == brute(data, 10)


def test_fewer_pairs_than_asked_for(spark):
    data = [(1, 5), (1, 6), (2, 7), (1, 5)]
    df = spark.createDataFrame(data, "b long, p long")
    assert rows(top_pairs(df, "b", "p", 10)) == [(5, 6, 1)]
    assert top_pairs(df.limit(0), "b", "p", 10).count() == 0


@pytest.mark.parametrize("seeds", [2, 5, 64])
def test_tasks_follow_the_number_of_pairs(spark, seeds, monkeypatch):
    monkeypatch.setattr(pairs, "TASK_PAIRS", 10)
    monkeypatch.setattr(pairs, "SEEDS", seeds)
    rng = random.Random(4)
    data = [(b, rng.randrange(15)) for b in range(60) for _ in range(rng.randrange(1, 9))] + [(b, p) for b in range(60) for p in (90, 91)]
    got = top_pairs(spark.createDataFrame(data, "b long, p long"), "b", "p", 20)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == brute(data, 20)
