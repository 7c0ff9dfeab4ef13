from __future__ import annotations

import random

import numpy as np
import pytest

from llm_data import corpus, prose

from panelwright.llm import near_duplicates as N
from panelwright.llm.graph import UnionFind, components


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent=80):
    sets = [shingles(t, size) for _, t, _ in rows]
    groups = UnionFind()
    for a in range(len(rows)):
        groups.find(a)
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                groups.union(a, b)
    out = []
    for k, (i, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if groups.find(j) == groups.find(k) and rows[j][0] is not None]
        low = min(ids) if ids and sets[k] else i
        out.append((i, len(sets[k]), low, i == low))
    return sorted(out, key=str)


def family(rng, n, edits, first):
    base = prose(rng, 120).split(" ")
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        out.append((first + k, " ".join(words), "f"))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_groups_match_brute_force(table, size):
    rng = random.Random(size)
    rows = corpus(7, 40) + family(rng, 60, 14, 2000) + family(rng, 40, 5, 1500)
    got = N.near_duplicates(table(rows), N.Similarity(size=size)).drop("text_hash")
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, size)


def test_one_document_of_each_group_stays(table):
    rows = [r for r in corpus(7, 30) if r[0] is not None] + family(random.Random(3), 20, 2, 900)
    docs = table(rows)
    left = N.keep_one(docs)
    assert left.columns == docs.columns
    stay = sorted({i for i, _, low, _ in brute(rows, 5) if i == low})
    assert sorted(r["doc_id"] for r in left.collect()) == stay


def test_empty_table(table):
    docs = table(corpus()).limit(0)
    assert N.near_duplicates(docs).count() == 0
    assert N.keep_one(docs).count() == 0


def test_signatures_estimate_similarity_and_do_not_depend_on_company():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(60):
        base = rng.integers(0, 2**63, 150).astype(np.uint64)
        share = rng.integers(40, 140)
        a, b = np.unique(base[:share]), np.unique(base)
        one = N.superminhash([a, b, base[:3]], 160)
        alone = N.superminhash([b], 160)
        assert (one[1] == alone[0]).all()
        errors.append((one[0] == one[1]).mean() - share / 150)
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < 0.04


def test_parities_never_drop_a_link_and_drop_most_others(spark):
    how = N.Similarity()
    rng = np.random.default_rng(6)
    rows = []
    for k in range(400):
        base = np.unique(rng.integers(0, 2**63, int(rng.integers(5, 900))).astype(np.uint64) * np.uint64(2))
        share = int(np.ceil(len(base) * (0.8 if k % 2 else 0.7)))
        rows.append((len(base), share, N.parities(base).tolist(), N.parities(base[:share]).tolist()))
    df = spark.createDataFrame(rows, "n long, m long, x array<long>, y array<long>")
    stay = {(r["n"], r["m"]) for r in df.where(N._possible("x", "y", "n", "m", how)).collect()}
    linked = {(n, m) for n, m, _, _ in rows if 100 * m >= 80 * n}
    assert linked <= stay and len(stay - linked) < 10


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(100, 180)] + [(500, k) for k in range(501, 560)] + [(9, 9), (None, 3), (4, None)]
    edges += [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(300)]
    rng.shuffle(edges)
    sets = UnionFind()
    for a, b in edges:
        if a is not None and b is not None and a != b:
            sets.union(a, b)
    want = sorted((x, sets.find(x)) for x in list(sets.parent))
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(5))
    assert sorted((r["node"], r["root"]) for r in got.collect()) == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_a_group_stays_where_ids_repeat_or_miss(table):
    rng = random.Random(8)
    near, other, nameless = family(rng, 6, 2, 0), family(rng, 4, 2, 0), family(rng, 5, 2, 0)
    rows = [(7, t, s) for _, t, s in near] + [(7, near[0][1], "f"), (9, near[1][1], "f")]
    rows += [(7, t, s) for _, t, s in other] + [(None, t, s) for _, t, s in nameless]
    rows += [(7, "", "f"), (7, "", "f"), (None, None, "f")]
    left = [(r["doc_id"], r["text"]) for r in N.keep_one(table(rows)).collect()]
    texts = [{t for _, t, _ in group} for group in (near, other, nameless)]
    assert [sum(t in group for _, t in left) for group in texts] == [1, 1, 1]
    assert {i for i, t in left if t in texts[0] | texts[1]} == {7}
    assert sorted((x for x in left if not x[1]), key=str) == [(7, ""), (None, None)]
