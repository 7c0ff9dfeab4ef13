from __future__ import annotations

import hashlib
import random

import pytest

from llm_data import corpus, prose

from panelwright.llm import decontamination as D


def brute(text, items):
    words = D.words_of(text)
    hit, ids = set(), set()
    for item, t in items:
        w = D.words_of(t)
        size = min(10, len(w))
        grams = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in grams:
                hit.update(range(i, i + size))
                if item is not None:
                    ids.add(str(item))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(1)
    items = [(k, prose(rng, n)) for k, n in enumerate([30, 12, 10, 9, 3, 25, 40])]
    items += [(7, None), (8, ""), (9, "..."), (3, prose(rng, 11)), (None, prose(rng, 14)), (10, "Ünï-çode42 ß wort ") , (2, items[0][1])]
    docs = corpus(2, 30)
    for k, (_, t) in enumerate(items):
        words = (t or "").split(" ")
        docs.append((500 + k, prose(rng, 20) + " " + (t or "").upper() + " " + prose(rng, 5), "p"))
        docs.append((600 + k, prose(rng, 7) + " ".join(words[3:14]) + "!", "p"))
        docs.append((700 + k, " ".join(words[:9]), "p"))
    docs.append((800, " ".join([items[0][1], items[0][1], items[1][1]]), "p"))
    return docs, items


def expected(docs, items):
    return sorted(((i, *brute(t, items)) for i, t, _ in docs), key=str)


@pytest.mark.parametrize("block_words", [1_000_000, 17])
def test_hits_match_brute_force(table, spark, data, block_words):
    docs, items = data
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = D.digest(D.hits(table(docs), benchmark, block_words))
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(docs, items)


@pytest.mark.parametrize("block_words", [1_000_000, 40])
def test_filter_keeps_clean_documents(table, spark, data, block_words):
    docs, items = data
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    left = D.keep_clean(table(docs), benchmark, block_words)
    assert left.columns == table(docs).columns
    clean = sorted((str(i) for i, t, _ in docs if not brute(t, items)[-1]))
    assert sorted(str(r["doc_id"]) for r in left.collect()) == clean


def test_empty_tables(table, spark, data):
    docs, items = data
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert D.digest(D.hits(table(docs).limit(0), benchmark)).count() == 0
    assert D.hits(table(docs), benchmark.limit(0)).where("size(spans) > 0").count() == 0
    assert D.keep_clean(table(docs), benchmark.limit(0)).count() == len(docs)


def test_shift_table_skips():
    words = [b"w%d" % k for k in range(40)]
    [tables] = D.build([(tuple(words[5:15]), "1")])
    assert tables[2].get((b"x", b"y"), tables[0] - tables[1] + 1) == 9
    assert [s for s, _ in D.search(tables, words)] == [5]
