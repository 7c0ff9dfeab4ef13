from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from panelwright.llm import spelling


def distance_one(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def words_of(seed: int, n: int = 300) -> list[str]:
    rng = random.Random(seed)
    out = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(n)}
    out |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "abababa", "babababa", "b" * 300, "b" * 301, "b" * 150 + "a" + "b" * 150}
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_rotations_and_ranks(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, [2, 3, 9, 91][seed], 200)
    text[0] = 200 % 91 if seed == 3 else 1
    text = np.r_[text, np.max(text) + 1]  # no repetition
    sigma = int(text.max()) + 1
    order = spelling.sorted_rotations(text, sigma)
    assert order.tolist() == sorted(range(len(text)), key=lambda k: [*text[k:], *text[:k]])
    ranks = spelling.Ranks(text, sigma)
    for _ in range(50):
        lo = int(rng.integers(0, 200))
        width, c = int(rng.integers(1, 201 - lo)), int(rng.integers(0, sigma))
        at, wide, less = ranks.step(np.array([c]), np.array([lo]), np.array([width]))
        span = text[lo : lo + width]
        assert (wide[0], less[0]) == ((span == c).sum(), (span < c).sum())
        assert not wide[0] or at[0] == (text < c).sum() + (text[:lo] == c).sum()
        who, symbols, *_ = ranks.children(np.array([lo]), np.array([width]))
        assert sorted(symbols.tolist()) == sorted(set(span.tolist())) and not who.any()


@pytest.mark.parametrize("cell", [1 << 19, 400])
def test_pairs_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(spelling, "CELL", cell)  # 400: groups of equal ends are cut into a grid
    monkeypatch.setattr(spelling, "CHUNK", 50)
    words = words_of(1)
    df = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, n long").repartition(3)
    got = sorted(tuple(r) for r in spelling.near_pairs(df).collect())
    assert got == sorted((a, b, k) for a in words for k, b in enumerate(words) if distance_one(a, b)) and got


def test_variants_of_documents(spark, table):
    rng = random.Random(5)
    base = ["kanelo", "Kanelo", "ténero", "TÉnero", "salomare", "salomara", "short", "kanelos", "kaneloss", "É" * 6]
    rows = []
    for k in range(120):
        text = " ".join(rng.choices(base, [60, 5, 30, 8, 20, 3, 5, 9, 2, 4], k=rng.randint(0, 60)))
        rows.append((k, text + rng.choice(["", "1", "_x\n"]) + "ÀÿxyzÀ" * (k % 3), "a"))
    rows += [(None, "kanelo " * 3, "a"), (3, None, "b"), (4, "", None), (5, "salomare" * 30_000, "a"), rows[7], rows[7]]

    counted = Counter()
    for i, text, _ in rows:
        for run in re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 7 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counted[run] += 1
    kept = {w: n for w, n in counted.items() if len(w) >= 6 and n >= 5}
    want = {}
    for w, n in kept.items():
        near = [v for v in kept if distance_one(v, w)]
        best = min(near, key=lambda v: (-kept[v], v), default=None)
        form = best if best and kept[best] >= 5 * n else None
        want[w] = (form, n, len(near), kept[form] if form else None)
    got = {r.word: r for r in spelling.variants(spelling.vocabulary(table(rows), mutate=7)).collect()}
    assert {w: (r.form, r.n, r.n_near, r.form_n) for w, r in got.items()} == want and any(r.form for r in got.values())
    for w, r in got.items():
        end = w
        while want[end][0]:
            end = want[end][0]
        assert r.root == end


def test_chains_and_empty(spark, table):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(11)], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w11"}
    assert spelling.variants(spelling.vocabulary(table([]))).count() == 0
    assert spelling.variants(spelling.vocabulary(table([(1, None, "a"), (2, "some words only", "a")]))).count() == 0
