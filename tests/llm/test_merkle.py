from __future__ import annotations

import hashlib

import numpy as np
import pytest
from llm_data import corpus
from pyspark.sql import functions as F

from panelwright.llm import merkle


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values) -> str:
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def brute(rows, tear):
    """(doc_id, source, leaf, subroot, root, proof, folded) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r), leaf((*r[:4], tear(r)))))
        trees[k] = levels([leaf(r) for r in groups[k]])
    top = levels([trees[k][-1][0] for k in keys])
    out = []
    for g, k in enumerate(keys):
        for i, r in enumerate(groups[k]):
            value, seen = leaf((*r[:4], tear(r))), ""
            for tree, at in ((trees[k], i), (top, g)):
                for level in tree[:-1]:
                    run, slot = level[at // 3 * 3 : at // 3 * 3 + 3], at % 3
                    seen += "".join(run[:slot] + run[slot + 1 :])
                    value, at = digest("".join(run[:slot] + [value] + run[slot + 1 :])), at // 3
            out.append((r[0], k, leaf(r), trees[k][-1][0], top[-1][0], digest(seen), value, value == top[-1][0]))
    return sorted(out, key=str)


def test_states_equal_the_standard_hash():
    rng = np.random.default_rng(0)
    for blocks in range(4):
        words = rng.integers(0, 1 << 32, (5, 8 * blocks), dtype=np.uint32)
        state = np.tile(merkle.START, (5, 1))
        for k in range(blocks):
            state = merkle.compress(state, merkle.hex_block(words[:, 8 * k : 8 * k + 8]))
        got = [x.tobytes().hex() for x in merkle.finished(state, np.full(5, blocks)).astype(">u4")]
        assert got == [digest(row.astype(">u4").tobytes().hex()) for row in words]


@pytest.mark.parametrize("depth", [8, 1, 2])
def test_equals_brute_force(spark, table, monkeypatch, depth):
    monkeypatch.setattr(merkle, "LEVELS", depth)  # 1, 2: subtrees of subtrees
    rows = corpus(seed=3, n=90) + [(500 + k, "x" * k, "hot") for k in range(163)] + [(700, "lone\nline", "solo"), (701, "long\n" * 200_000, "a")]
    docs = table(rows)
    got = merkle.manifest(docs, {"text": F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
    assert got.columns == ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    full = [(i, s, None, len(t or ""), t) for i, t, s in rows]
    tear = lambda r: r[4].replace("\n", "") if r[4] is not None and r[0] is not None and r[0] % 2 == 0 else r[4]
    want = brute(full, tear)
    assert sorted([tuple(r) for r in got.collect()], key=str) == want and not all(r[-1] for r in want)


def test_one_row_and_none(spark, table):
    one = merkle.manifest(table([(1, "a", None)]), {}).collect()[0]
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == digest("") and one.verified
    assert merkle.manifest(table([]), {}).count() == 0
