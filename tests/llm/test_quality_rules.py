from __future__ import annotations

import random
import re
from collections import Counter

from llm_data import corpus, prose

from panelwright.llm import quality_rules as Q


def brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {p for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_upper": sum("A" <= c <= "Z" for c in text or ""),
        "n_exclaims": (text or "").count("!"),
    }


def rows():
    rng = random.Random(4)
    line = prose(rng, 12)
    odd = ["x " * 40, f"{line}\n{line}\n \n{line} {prose(rng, 30)} {line}", "A!! B!! " * 20, "# * $ | <a> &", "é𝒳 ñ\x0b\x1cß " * 9, "a b c d e f g h a b c d e f g h"]
    return corpus() + [(1000 + k, t, "s") for k, t in enumerate(odd)]


def test_measures_match_brute_force(table):
    data = rows()
    got = Q.verdicts(Q.ledger(table(data))).collect()
    want = sorted(((i, *brute(t).values()) for i, t, _ in data), key=str)
    assert sorted(((r["doc_id"], *(r[m] for m in brute("")),) for r in got), key=str) == want
    for r in got:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed
        assert r["kept"] == (r["fail_bits"] == 0)


def test_policies_and_ablation(table):
    data = rows()
    ledger = Q.ledger(table(data)).cache()
    bits = [r["fail_bits"] for r in ledger.collect()]
    for r in Q.ablation(ledger).collect():
        mask, bit = Q.POLICIES[r["policy"]], Q.mask(r["rule"])
        hit = [b & mask for b in bits]
        assert r["n_docs"] == len(bits)
        assert r["n_failed"] == sum(h & bit != 0 for h in hit)
        assert r["n_only"] == sum(h == bit for h in hit)
        assert r["n_kept"] == sum(h == 0 for h in hit)
        assert r["n_kept_without"] == sum(h & ~bit == 0 for h in hit)
    assert {r["policy"] for r in Q.ablation(ledger).collect()} == set(Q.POLICIES)


def test_filter_keeps_columns_and_empty_table(table, spark):
    docs = table(rows())
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    good = {r["doc_id"] for r in Q.verdicts(Q.ledger(docs)).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == good
    assert Q.keep_good(docs.limit(0)).count() == 0
    assert Q.ablation(Q.ledger(docs.limit(0))).count() == 0


def test_no_python_in_the_plan(table):
    plan = Q.verdicts(Q.ledger(table(rows())))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
