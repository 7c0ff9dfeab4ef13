from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from llm_data import prose

from panelwright.llm import toxicity as T

BAD = ["grumbor", "snarvik", "plodwen"]


def leet(word: str, rng: random.Random) -> str:
    swaps = {"o": "0", "i": "1", "e": "3", "a": "4"}
    kind = rng.randrange(4)
    if kind == 0:
        return "".join(swaps.get(c, c) for c in word)
    if kind == 1:
        return " ".join(word)
    if kind == 2:
        return ".".join(word)
    return word[:2] + word[2] * 4 + word[3:]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(600):
        words = prose(rng, rng.randint(20, 60)).split(" ")
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                bad = rng.choice(BAD)
                words.insert(rng.randrange(len(words)), leet(bad, rng) if held(k) else bad)
        rows.append((k, " ".join(words), "s"))
        labels.append((k, int(toxic)))
    rows += [(7000 + k, rows[5][1], "s") for k in range(80)]  # copies of one toxic text
    labels += [(7000 + k, 1) for k in range(80)]
    labels += [(9000, 1), (None, 1), (3, None)]
    return rows, labels


def held(i) -> bool:
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_documents_are_told_apart(table, spark, data):
    rows, labels = data
    edge = [(8000, None, "s"), (8001, "", "s"), (None, "x", "s")]
    marks = spark.createDataFrame([(i, t, 1) for i, t in labels], "doc_id long, toxic int, quality int")
    got = T.scored(table(rows + edge), marks).collect()
    assert len(got) == len(rows) + 3
    truth = dict(labels)
    for r in got:
        assert r["held_out"] == (held(r["doc_id"]) if r["doc_id"] is not None else zlib.crc32(b"") % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if r["doc_id"] in (8000, 8001, None):
            assert r["score"] == T.FLOOR
    test = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600 and truth.get(r["doc_id"]) is not None]
    toxic = [r for r in test if truth[r["doc_id"]]]
    assert sum(r["predicted"] for r in toxic) >= 0.9 * len(toxic)
    assert sum(r["predicted"] for r in test if not truth[r["doc_id"]]) == 0


def test_without_toxic_labels_and_empty_tables(table, spark, data):
    rows, _ = data
    none = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {r["score"] for r in T.scored(table(rows[:50]), none).collect()} == {T.FLOOR}
    assert T.scored(table(rows[:5]).limit(0), none.limit(0)).count() == 0


def test_trigrams_are_counted_over_whole_texts(table):
    rows = [(1, "Ab abb, éa 1a", "s"), (2, None, "s"), (3, "", "s"), (4, "ab\nab", "s")]
    want = np.zeros((27, 27, 27), np.int64)
    for _, t, _ in rows:
        for word in re.findall("[a-z]+", T.folded(t or "")):
            x = [26, 26, *(ord(c) - 97 for c in word), 26]
            for a, b, c in zip(x, x[1:], x[2:]):
                want[a, b, c] += 1
    assert (T.trigram_counts(table(rows)) == want).all()


def brute_decode(token, model):
    best = None
    paths = [("", 0.0)]
    for options in T.lattice(token):
        paths = [(w + (T.LETTERS[k] if k is not None else ""), cost + price) for w, cost in paths for k, price in options]
    for w, cost in paths:
        x = [26, 26, *(ord(c) - 97 for c in w), 26]
        total = cost + sum(model[a][b][c] for a, b, c in zip(x, x[1:], x[2:]))
        best = min(best or (total, w), (total, w))
    return best[0]


def test_viterbi_finds_the_cheapest_path():
    rng = np.random.default_rng(2)
    model = T.language_model(rng.integers(0, 50, (27, 27, 27)))
    for token in ("1d10t", "a.b.c", "heeey", "$1m", "4@4", "x-1-x", "b*d"):
        word = T.decoded(token, model)
        want = brute_decode(token, model)
        paths = [("", 0.0)]
        for options in T.lattice(token):
            paths = [(w + (T.LETTERS[k] if k is not None else ""), c + p) for w, c in paths for k, p in options]
        x = [26, 26, *(ord(c) - 97 for c in word), 26]
        language = sum(model[a][b][c] for a, b, c in zip(x, x[1:], x[2:]))
        assert min(c for w, c in paths if w == word) + language == pytest.approx(want)


def test_spaced_words_beside_single_letters_and_each_other(table, spark, data):
    rows, labels = data
    spoken = [(20_000 + k, "a " + re.sub(" ", " a ", t, count=4), s) for k, (_, t, s) in enumerate(rows[:600]) if k % 5]  # "a" is a word
    hidden = {
        30_000: f"nobo kati a {' '.join('grumbor')} reta",
        30_001: f"nobo kati {' '.join('snarvik')} {' '.join('plodwen')} reta",
        30_002: f"nobo kati a {' '.join('plodwen')} a {' '.join('grumbor')} a reta",
    }
    ids = table(rows + spoken + [(k, t, "s") for k, t in hidden.items()])
    marks = spark.createDataFrame([(i, t, 1) for i, t in labels], "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r for r in T.scored(ids, marks).collect()}
    assert all(got[k]["predicted"] for k in hidden)
    one = got[30_000]["score"]
    assert got[30_001]["score"] > one and got[30_002]["score"] > one
    assert not any(got[i]["predicted"] for i, _, _ in spoken)


def test_borders_are_opened_at_the_models_price():
    counts = np.zeros((27, 27, 27), np.int64)
    for word, n in (("a", 50), ("stupid", 5), ("idiot", 5), ("moron", 5), ("person", 50)):
        x = [26, 26, *(ord(c) - 97 for c in word), 26]
        for a, b, c in zip(x, x[1:], x[2:]):
            counts[a, b, c] += n
    restore = T.Restorer(T.language_model(counts))
    assert {"a", "stupid"} <= restore.words("you are a s t u p i d person")
    assert {"idiot", "moron"} <= restore.words("i d i o t m o r o n")
    long = restore.words("s t u p i d " * 5000)
    assert "stupid" in long


DOUBLED_AND_SIGNS = ["ggrumbor", "grummbor", "ssnarvik", "snarvvik", "plodwwen", "g:r:u:m:b:o:r", "sn^arvik", "plod=wen", "p,l,o,d,w,e,n", "grum;bor", "sn%ar&vik"]


def test_doubled_letters_and_other_signs_are_decoded(table, spark, data):
    rows, labels = data
    hidden = [(30_000 + k, f"nobo kati {w} reta", "s") for k, w in enumerate(DOUBLED_AND_SIGNS)]
    marks = spark.createDataFrame([(i, t, 1) for i, t in labels], "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r["score"] for r in T.scored(table(rows + hidden), marks).collect()}
    assert [w for k, w in enumerate(DOUBLED_AND_SIGNS) if got[30_000 + k] < 0.7] == []


def test_written_words_stay_beside_decoded_ones():
    restore = T.Restorer(T.language_model(np.ones((27, 27, 27), np.int64)))
    assert {"kette", "one", "two"} <= restore.words("kette one=two")
