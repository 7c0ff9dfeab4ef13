from __future__ import annotations

import pytest

import re
from collections import Counter, defaultdict

import numpy as np
from llm_data import corpus

from panelwright.llm import mixing as M


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Shares by weight 1, 2, 3; what is above three times a size goes back until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = {s: (total - sum(fixed.values())) * weight[s] / sum(w for x, w in weight.items() if x not in fixed) for s in names if s not in fixed}
        over = [s for s, t in rest.items() if t > 3 * sizes[s]]
        if not over:
            return fixed | rest
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 65, 1000):
        p = M.Permutation(n, 3)
        assert sorted(p(np.arange(n))) == list(range(n))


def test_shard_draws_are_spread_and_add_up():
    sources = [M.Source("a", 0, 0, 10, 0), M.Source("b", 0, 0, 9000, 9000), M.Source("c", 0, 0, 500, 1000)]
    counts = M.shard_counts(sources, 16)
    assert counts.sum(axis=0).tolist() == [0, 9000, 1000]
    assert set(counts.sum(axis=1)) == {625}
    assert 20 < counts[:, 2].min() and counts[:, 2].max() < 110 and len(set(counts[:, 2])) > 4


def test_words_taken_come_near_targets(table):
    rows = corpus(11, 200)
    got = M.taken(table(rows)).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += n_words(t)
    want = brute_targets(sizes)
    source_of = defaultdict(set)
    for i, t, s in rows:
        source_of[i, n_words(t)].add(s)
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), n_words(t)) for i, t, _ in rows)
    by = Counter()
    for r in got:
        [s] = {s for s in source_of[r["doc_id"], r["size"]] if sizes[s] == r["source_size"]}
        assert abs(r["target"] - want[s]) < 1e-6 * want[s] + 1e-9
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[s] += r["taken"]
    for s, aim in want.items():
        assert abs(by[s] - aim) <= M.BLOCK_WORDS
    again = M.taken(table(rows)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_slots_follow_the_permutations(table, spark):
    docs = table(corpus(12, 80))
    rows = M.counted(docs)
    sources = M.catalogue(rows)
    slots = M.slots(spark, sources, 7).collect()
    assert len({(s["shard"], s["slot"]) for s in slots}) == len(slots) == sum(s.draws for s in sources)
    for k, source in enumerate(sources):
        seen = Counter((s["epoch"], s["block"]) for s in slots if s["src"] == k)
        assert set(seen.values()) <= {1}
        order = M.Permutation(source.blocks, k)(np.arange(source.blocks)) if source.blocks else []
        want = {(j // source.blocks, int(order[j % source.blocks])) for j in range(source.draws)}
        assert set(seen) == want


def test_mix_as_documents(table):
    rows = [r for r in corpus(13, 120) if r[0] is not None and r[0] != 2]
    docs = table(rows)
    taken = {r["doc_id"]: r["taken"] for r in M.taken(docs).collect()}
    text = {i: t for i, t, _ in rows}
    out = M.mixed(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        mine, whole = re.findall(r"[^\x20\x09-\x0D]+", r["text"]), Counter(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]]))
        assert not Counter(mine) - whole
        assert r["text"] == text[r["doc_id"]] or len(mine) < sum(whole.values())
        assert r["n_chars"] == len(r["text"]) and r["verdict"] == "v"
        words[r["doc_id"]] += len(mine)
    assert {i: n for i, n in taken.items() if n} == dict(words)


def test_nothing_to_mix(table):
    blank = [(1, None, "a"), (2, "", None), (2, " ", None)]
    assert sorted((r["doc_id"], r["taken"], r["target"]) for r in M.taken(table(blank)).collect()) == [(1, 0, 0.0), (2, 0, 0.0), (2, 0, 0.0)]
    assert M.mixed(table(blank)).count() == 0
    assert M.taken(table(blank).limit(0)).count() == 0
    assert M.mixed(table(blank).limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000, 3_000_001])
def test_places_are_the_inverse(n):
    order = M.Permutation(n, 3)
    some = np.unique(np.linspace(0, n - 1, min(n, 5000)).astype(np.int64))
    assert (order.place(order(some)) == some).all() and (order(order.place(some)) == some).all()


def test_more_than_a_million_blocks_know_their_short_one():
    """The last block has one word: two neighbouring numbers of draws differ by a word where it is met."""
    blocks, words = 1_500_000, 64
    size = (blocks - 1) * words + 1
    last = int(M.Permutation(blocks, 7).place(np.array([blocks - 1]))[0])
    target = float(last * words + 1)  # nearest with the short block, and no other block
    assert M.draws_for(target, size, words, 7)[1] in (last, last + 1)
    after = float((last + 9) * words + 1)
    assert M.draws_for(after, size, words, 7)[1] == last + 10
