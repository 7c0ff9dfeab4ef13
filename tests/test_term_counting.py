import math
import re
from collections import Counter

import pytest
from helpers import rows

from panelwright.functions import estimators
from panelwright.plans import text as X

DOCS = [
    (1, "aa bb aa bb, aa ünïx"), (2, None), (3, ""), (4, "cc"), (5, "bb aa bb"), (5, "bb aa zz"), (None, "aa bb"), (None, "cc cc"),
    (6, "x y z"), (7, "dd " * 40 + "aa bb"), (8, "aa_1 aa_1"),
]


def terms(text):
    words = re.findall(r"\w{2,}", (text or "").lower())
    return [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]


@pytest.fixture(params=[4, 500_000])
def docs(spark, request, monkeypatch):
    monkeypatch.setattr(estimators, "_WORDS", request.param)  # few words at a time, too
    return spark.createDataFrame(DOCS, "doc_id long, text string").coalesce(1)


def by_id():
    out = {}
    for k, text in DOCS:
        out.setdefault(k, Counter()).update(terms(text))
    return {k: c for k, c in out.items() if c}


def test_profile_with_repeated_and_missing_ids(docs):
    want = [(k, sum(c.values()), len(c), sum(len(t) * n for t, n in c.items()), min(c, key=lambda t: t.encode()), max(c.values())) for k, c in by_id().items()]
    got = X.term_profile(docs, "doc_id", "text")
    assert sorted(map(str, rows(got))) == sorted(map(str, want))


def test_terms_of_single_rows_are_not_shuffled(docs, spark):
    alone = docs.where("doc_id < 5")
    profile = X.term_profile(alone, "doc_id", "text")
    assert rows(profile.select("doc_id", "n_terms")) == [(1, 11), (4, 1)]
    made = profile._jdf.queryExecution().optimizedPlan().toString().split("Union")[1]
    assert "MapInArrow" in made and "row_profile" in made.split("Generate")[0]


def test_vocabulary_adds_up_documents(docs):
    df, total = Counter(), Counter()
    for _, text in DOCS:
        df.update(set(terms(text)))
        total.update(terms(text))
    want = sorted((t, n, total[t]) for t, n in df.items() if n >= 2)
    assert rows(X.vocabulary(docs, "text"), "term", "df", "total") == want


def test_limited_vocabulary_gives_the_joined_weights(docs, spark):
    from pyspark.sql import functions as F

    known = {"aa": (0, 3), "aa bb": (1, 2), "cc": (2, 2), "dd dd": (3, 1)}
    vocab = spark.createDataFrame([(t, i, n) for t, (i, n) in known.items()], "term string, idx int, df long")
    want = {}
    for k, c in by_id().items():
        raw = {known[t][0]: n * (math.log(6 / (1 + known[t][1])) + 1) for t, n in c.items() if t in known}
        if raw:
            length = math.sqrt(sum(v * v for v in raw.values()))
            want[k] = ([*sorted(raw)], [round(raw[i] / length, 9) for i in sorted(raw)])
    for limited in (False, True):
        made = X.tfidf_rows(docs, "text", vocab, F.lit(5), "doc_id", limited).collect()
        assert len(made) == len(want)
        assert {r.doc_id: (r.idx, [round(v, 9) for v in r.val]) for r in made} == want


def test_no_document_has_a_term(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert X.vocabulary(docs, "text").count() == X.term_profile(docs, "doc_id", "text").count() == 0
