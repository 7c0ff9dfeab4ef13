from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

from llm_data import corpus, prose

from panelwright.llm import sharding as S


def size(text):
    return len((text or "").encode()) + 8


def plain_best_fit(sizes, capacity):
    """One item at a time into the tightest bin, searched by going through all."""
    bins, out = [], []
    for s in sizes:
        fits = [(room, k) for k, room in enumerate(bins) if room >= s]
        if fits:
            _, k = min(fits)
        else:
            k = len(bins)
            bins.append(capacity)
        bins[k] -= s
        out.append(k)
    return bins, out


def test_runs_pack_like_one_item_at_a_time():
    rng = random.Random(0)
    for _ in range(30):
        sizes = sorted((rng.choice([3, 5, 8, 13, 40, 41, 60]) for _ in range(rng.randint(0, 200))), reverse=True)
        counted = sorted(Counter(sizes).items(), reverse=True)
        packed = S.best_fit_decreasing(counted, 100)
        rooms, bins = plain_best_fit(sizes, 100)
        loads = Counter()
        for (s, n), runs in zip(counted, packed, strict=True):
            assert sum(c for _, c in runs) == n
            for k, c in runs:
                loads[k] += s * c
        assert sorted(loads.values()) == sorted(100 - r for r in rooms)
        assert len(loads) == len(rooms)


def test_tree_finds_the_tightest_bin():
    rng = random.Random(1)
    tree, held = S.BinTree(), set()
    for step in range(2000):
        if held and rng.random() < 0.4:
            key = rng.choice(sorted(held))
            tree.remove(key)
            held.discard(key)
        else:
            key = (rng.randint(0, 50), step)
            tree.insert(key)
            held.add(key)
        want = rng.randint(0, 50)
        assert tree.best_fit(want) == min((k for k in held if k[0] >= want), default=None)


def check(rows, got, shards):
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted(
        (str(i), size(t), zlib.crc32((t or "").encode())) for i, t, _ in rows
    )
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))


def test_groups_stay_together_and_shards_are_equal(table):
    rng = random.Random(2)
    rows = corpus(3, 300) + [(5000 + k, prose(rng, 30), "s") for k in range(1500)]
    got = S.digest(S.sharded(table(rows), 8)).collect()
    check(rows, got, 8)
    loads = Counter()
    where = defaultdict(set)
    for r in got:
        loads[r["shard"]] += r["size"]
        where[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    assert max(loads.values()) <= 1.01 * min(loads.values())


def test_a_group_larger_than_a_share_is_cut(table):
    rng = random.Random(3)
    rows = [(k, "the same text again", "s") for k in range(3000)] + [(9000 + k, prose(rng, 12), "s") for k in range(1500)]
    got = S.digest(S.sharded(table(rows), 6)).collect()
    check(rows, got, 6)
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) <= 1.05 * min(loads.values())


def test_few_empty_and_no_documents(table):
    for rows in ([(1, None, "a")], [(1, None, "a"), (2, "", "a"), (2, "", "a"), (None, "x", None)]):
        check(rows, S.digest(S.sharded(table(rows), 24)).collect(), 24)
    assert S.digest(S.sharded(table([(1, "a", "b")]).limit(0), 24)).count() == 0
