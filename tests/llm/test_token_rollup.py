from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import pytest
from llm_data import corpus, prose

from panelwright.llm import token_rollup as R

pytestmark = pytest.mark.skipif(not Path(R.FOLDER, R.VERSIONS["byte-bpe-50k/1"]).exists(), reason="no vocabulary file")


@pytest.fixture(scope="module")
def encode():
    return R._encoder(R.ranks("byte-bpe-50k/1"))


def totals(held, encode):
    docs, tokens = Counter(), Counter()
    for _, t, s in held:
        docs[s] += 1
        tokens[s] += len(encode(t)) if t else 0
    return sorted(((s, docs[s], tokens[s]) for s in docs), key=str)


def read(ledger):
    rows = ledger.totals().collect()
    assert {(r["lang"], r["tokenizer"]) for r in rows} <= {(None, "byte-bpe-50k/1")}
    return sorted(((r["source"], r["n_docs"], r["n_tokens"]) for r in rows), key=str)


def test_batches_add_up_and_repeat_without_effect(table, spark, tmp_path, encode):
    rng = random.Random(3)
    rows = corpus(5, 30)
    ledger = R.Rollup(spark, f"file://{tmp_path}/ledger")
    assert read(ledger) == []
    assert ledger.commit("a", changed=table(rows), new_ids=True)
    assert read(ledger) == totals(rows, encode)
    assert not ledger.commit("a", changed=table(rows))
    gone = table([(2, None, "x"), (4, None, "x"), (777, None, "x"), (None, None, "x"), (4, None, "x")])
    assert ledger.commit("b", removed=gone)
    held = [r for r in rows if r[0] not in (2, 4)]
    assert read(ledger) == totals(held, encode)
    new = [(0, prose(rng, 50), "moved"), (1, None, "a"), (5, prose(rng, 9), "b"), (5, "twice", "b"), (900, "new one", "a"), (4, "back", "a")]
    for _ in range(2):
        ledger.commit("c", changed=table(new), removed=table([(6, "", "")]))
    held = [r for r in held if r[0] not in (0, 1, 5, 6)] + new
    assert read(ledger) == totals(held, encode)
    assert ledger.commit("d", changed=table(rows).limit(0))
    assert read(ledger) == totals(held, encode)
    assert ledger.committed() == ["a", "b", "c", "d"]


def test_a_batch_that_broke_off_is_written_anew(table, spark, tmp_path, encode):
    rows = corpus(6, 10)
    ledger = R.Rollup(spark, f"file://{tmp_path}/ledger")
    table(rows).select("doc_id").write.parquet(f"file://{tmp_path}/ledger/rows/a")  # left behind, never committed
    assert ledger.committed() == [] and read(ledger) == []
    assert ledger.commit("a", changed=table(rows), new_ids=True)
    assert read(ledger) == totals(rows, encode)


def test_long_runs_give_the_tokens_of_the_pattern(encode, monkeypatch):
    rng = random.Random(4)
    spaces = [" ", "\n", "\t", " ", " ", "　", "\x1c"]
    texts = ["".join(rng.choice([*spaces, *spaces, "a", "7", "!", "'s", "é"]) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    want = [encode(t) for t in texts]
    monkeypatch.setattr(R, "LONG_SPACE", __import__("re").compile(R.LONG_SPACE.pattern.replace("2000", "2")))
    assert [encode(t) for t in texts] == want


@pytest.mark.parametrize("sign", [" ", "\n", "x", "!", "7", "　"])
def test_a_million_equal_signs(encode, sign):
    tokens = encode("a" + sign * 1_000_000 + " b")
    assert 0 < len(tokens) <= 3_000_100
