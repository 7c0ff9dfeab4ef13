from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline as P
from llm_data import corpus, prose
from test_decontamination import brute as contaminated
from test_near_duplicates import brute as groups
from test_quality_rules import brute as measures

from panelwright.llm import mixing


def good(text):
    m = measures(text)
    n = m["n_words"]
    return not (
        n < 20 or 100 * m["n_repeat_words"] > 30 * n or 100 * m["n_symbols"] > 10 * n or m["word_chars"] < 3 * n or m["word_chars"] > 12 * n
        or 2 * m["n_dup_lines"] > m["n_lines"] or 100 * m["n_upper"] > 40 * m["word_chars"] or 2 * m["n_exclaims"] > n
    )


def test_stages_against_brute_force(table, spark, tmp_path):
    rng = random.Random(2)
    rows = [r for r in corpus(21, 80) if r[0] is not None and r[0] != 2]
    items = [(k, prose(rng, 30)) for k in range(4)]
    rows += [(3000 + k, prose(rng, 40) + " " + t, "a") for k, t in items]
    folder = str(tmp_path)
    table(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    want = [r for r in rows if good(r[1])]
    stay = {i for i, _, low, _ in groups(want, 5) if i == low}
    want = [r for r in want if r[0] in stay]
    want = [r for r in want if not contaminated(r[1], items)[-1]]
    assert 10 < len(want) < len(rows) - 10

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, folder)
        if k < len(P.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k == 2:
            assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted((i, t) for i, t, _ in want)
            taken = {r["doc_id"]: r["taken"] for r in mixing.taken(docs).collect()}
    words = Counter()
    for r in spark.read.parquet(f"{folder}/3").collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert dict(words) == {i: n for i, n in taken.items() if n}
    loads = Counter()
    for r in docs.collect():
        loads[r["shard"]] += 1
    assert sum(loads.values()) == spark.read.parquet(f"{folder}/3").count()
    run = P.run(spark, folder)
    assert sorted(map(str, run.collect())) == sorted(map(str, docs.collect()))
