import math

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import Observation
from pyspark.sql import functions as F

from panelwright.operators.contracts import ingest_quality
from panelwright.plans import documents as H
from panelwright.plans import text as X

TEXTS = [
    (1, "Trade review: exports rose, exports fell.", 1, "trade"),
    (2, "The health review of hospitals; hospitals grew", 1, "health"),
    (3, "Exports and tariff trade", 2, "trade"),
    (4, "health of patients and hospitals été", 3, "health"),
    (5, "A b c", 5, "trade"),
    (6, "hospitals exports été été", 5, "health"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return X.group_split(spark.createDataFrame(TEXTS, "doc_id long, text string, family int, topic string"), F.col("family")).cache()


def plain_terms(text):
    import re

    w = re.findall(r"(?u)\b\w\w+\b", text.lower())
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain_weights():
    from collections import Counter

    train = [t for t in TEXTS if t[2] % 5]
    total, docs = Counter(), Counter()
    for _, text, *_ in train:
        total.update(plain_terms(text))
        docs.update(set(plain_terms(text)))
    vocab = {t for t in docs if docs[t] >= 2}
    out = {}
    for i, text, *_ in TEXTS:
        raw = {t: c * (math.log((1 + len(train)) / (1 + docs[t])) + 1) for t, c in Counter(plain_terms(text)).items() if t in vocab}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.update({(i, t): v / norm for t, v in raw.items()})
    return out, {t: (docs[t], total[t]) for t in vocab}


def test_terms_vocabulary_and_weights(corpus):
    weights, vocab = plain_weights()
    model = X.TextModel(corpus)
    assert {r.term: (r.df, r.total) for r in model.vocab.collect()} == vocab
    got = {(r.doc_id, r.term): r.weight for r in model.weights.collect()}
    assert got.keys() == weights.keys()
    assert all(got[k] == pytest.approx(weights[k]) for k in weights)


def test_short_texts_have_no_pairs(spark):
    df = spark.createDataFrame([(1, "word"), (2, ""), (3, "!"), (4, "two words")], "i long, t string")
    assert rows(X.with_terms(df, "t"), "i", "terms") == [(1, ["word"]), (2, []), (3, []), (4, ["two", "words", "two words"])]


def test_vocabulary_limit_breaks_ties_by_term(corpus):
    train = corpus.where("split = 'train'")
    assert len(X.vocabulary(train, "text", max_terms=3).collect()) == 3
    full = sorted(((-r.total, r.term) for r in X.vocabulary(train, "text").collect()))
    assert sorted(r.term for r in X.vocabulary(train, "text", max_terms=3).collect()) == sorted(t for _, t in full[:3])


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(0)
    dense = rng.random((120, 40)) * (rng.random((120, 40)) < 0.3)
    # A spectrum with gaps, as in real text.
    u, s, vt = np.linalg.svd(dense, full_matrices=False)
    data = [(i, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for i, r in enumerate(dense)]
    df = spark.createDataFrame(data, "doc_id long, idx array<int>, val array<double>").repartition(5)
    basis, values = X.svd_basis(df.select("idx", "val"), 40, 5, passes=40)
    assert np.allclose(values, s[:5], rtol=1e-8)
    assert np.allclose(np.abs(basis.T @ vt[:5].T), np.eye(5), atol=1e-6)
    from panelwright.functions.estimators import row_product

    shared = spark.sparkContext.broadcast(basis)
    got = {r.doc_id: r.e for r in df.mapInPandas(row_product(shared), "doc_id long, e array<double>").collect()}
    assert np.allclose(np.array([got[i] for i in range(120)]), dense @ basis)


@pytest.mark.parametrize("cells", [2_000_000, 1])
def test_products_of_few_rows_at_a_time(spark, monkeypatch, cells):
    from panelwright.functions import estimators

    monkeypatch.setattr(estimators, "_CELLS", cells)
    rng = np.random.default_rng(1)
    data = [(i, [], []) if i % 7 == 0 else (i, [i % 11, i % 11 + i % 3, 30], rng.random(3).tolist()) for i in range(150)]
    dense, basis = np.zeros((150, 40)), rng.random((40, 5))
    for i, idx, val in data:
        np.add.at(dense[i], idx, val)  # a column may come twice
    df = spark.createDataFrame(data, "doc_id long, idx array<int>, val array<double>").repartition(3)
    shared = spark.sparkContext.broadcast(basis)
    projected = {r.doc_id: r.e for r in df.mapInPandas(estimators.row_product(shared), "doc_id long, e array<double>").collect()}
    assert np.allclose([projected[i] for i in range(150)], dense @ basis)
    total = np.zeros_like(basis)
    for r in df.select("idx", "val").mapInArrow(estimators.gram_product(shared), "t int, z array<double>").collect():
        total[r.t] += r.z
    assert np.allclose(total, dense.T @ dense @ basis)


def test_repeated_passes_take_one_task_a_core(spark):
    from panelwright.runtime import one_task_a_core

    cores = spark.sparkContext.defaultParallelism
    assert one_task_a_core(spark.range(0, 100, 1, 5 * cores)).rdd.getNumPartitions() == cores
    assert one_task_a_core(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == 1


def test_classifiers_read_rows_made_once(spark):
    from panelwright.catalog import text as C

    model = X.TextModel(X.group_split(spark.createDataFrame(TEXTS, "doc_id long, text string, family int, topic string"), F.col("family")), dimensions=2)
    made = C.labelled(spark, "/root/testdata/sf0.001", model)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert made.count() == len(TEXTS) and "Join" not in plan


def test_split_keeps_families_together(corpus, spark):
    assert rows(X.check_split(corpus, "family")) == [(True, 0)]
    leaky = spark.createDataFrame([(1, "train"), (1, "test"), (2, "test")], "family int, split string")
    assert rows(X.check_split(leaky, "family")) == [(False, 1)]


def test_macro_f1_counts_absent_classes(spark):
    data = [("a", "a")] * 3 + [("a", "b"), ("b", "a"), ("c", "a"), ("b", "d")]
    got = X.classification_metrics(spark.createDataFrame(data, "y string, p string"), "y", "p").first()
    f1 = {"a": 2 * 3 / (4 + 5), "b": 0.0, "c": 0.0, "d": 0.0}
    assert (got.accuracy, got.macro_f1, got.n) == (pytest.approx(3 / 7), pytest.approx(np.mean(list(f1.values()))), 7)


def test_classifier_end_to_end(spark):
    topics = {"labor": "wages workers firms jobs", "health": "hospitals patients clinics medicine", "trade": "exports imports tariff customs"}
    data, i = [], 0
    for family in range(20):
        for topic, vocabulary in topics.items():
            w = vocabulary.split()
            data.append((i, f"{w[family % 4]} and {w[(family + 1) % 4]} in program {family % 3}", family, topic))
            i += 1
    df = X.group_split(spark.createDataFrame(data, "doc_id long, text string, family int, topic string"), F.col("family"))
    model = X.TextModel(df, dimensions=8)
    embedded = model.corpus.select("doc_id", "split", "topic").join(model.embedding, "doc_id")
    held_out = X.train_classifier(embedded, "topic").where("split = 'test'")
    got = X.classification_metrics(held_out, "actual", "pred").first()
    assert (got.n, got.accuracy, got.macro_f1) == (12, 1.0, 1.0)
    wide = X.embeddings_wide(model.embedding, 8)
    assert wide.columns == ["doc_id", *[f"e{k:03d}" for k in range(8)]] and wide.count() == 60


def test_classifier_of_two_classes_after_an_observation(spark):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    data = [(i, [float(i % 2), float(i % 3)], "train" if i < 40 else "test", "no" if i % 2 else "yes") for i in range(60)]
    embedded = spark.createDataFrame(data, "doc_id long, e array<double>, split string, label string")
    made = X.train_classifier(embedded, "label")
    assert rows(made, "doc_id", "split", "actual", "pred") == [(i, split, label, label) for i, _, split, label in data]


# -- documents ----------------------------------------------------------------------------------------


def pages(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "i int, body string")


def test_html_metadata(spark):
    good = (
        '<html><head><title>Notice GOV-000001</title></head><body><article data-id="GOV-000001" data-revision="2"><h1>x</h1>'
        '<time>04/03/2024</time><span class="agency">Labor Bureau</span><span class="doctype">notice</span></article></body></html>'
    )
    unclosed = '<html><head><title>T</title></head><body><div data-id="GOV-000701"><span class="agency">Trade Authority'
    untitled = '<title></title><article data-id="GOV-000613"><time>2024-01-02</time></article>'
    bare = '<article data-id="GOV-000997" data-revision="3"><h1>Report revised</h1></article>'
    got = H.extract_html_meta(pages(spark, good, unclosed, untitled, bare)).orderBy("i").select(*H.META).collect()
    assert tuple(got[0]) == ("GOV-000001", "Notice GOV-000001", "04/03/2024", "Labor Bureau", "notice", 2)
    assert tuple(got[1]) == ("GOV-000701", "T", None, "Trade Authority", None, 1)
    assert tuple(got[2]) == ("GOV-000613", None, "2024-01-02", None, None, 1)
    assert (got[3].title, got[3].revision) == ("Report revised", 3)


def test_text_lines(spark):
    body = "Document ID: GOV-000010\nTitle: \nDate: 2024-11-11\nAgency: Labor Bureau\nType: notice\nRevision: 1"
    got = H.extract_kv_meta(pages(spark, body, "no keys here")).orderBy("i").select(*H.META).collect()
    assert tuple(got[0]) == ("GOV-000010", None, "2024-11-11", "Labor Bureau", "notice", 1)
    assert tuple(got[1]) == (None, None, None, None, None, 1)


def test_attempts_documents_failures(spark):
    def html(rev):
        return f'<title>T{rev}</title><article data-id="D1" data-revision="{rev}"><time>2024-01-0{rev}</time></article>'

    log = spark.createDataFrame(
        [
            ("u1", 1, 429, None, None, "html"), ("u1", 2, 200, None, html(1), "html"),
            ("u2", 1, 500, None, None, "html"), ("u2", 2, 200, None, html(2), "html"),
            ("r3", 1, 302, "u3", None, "html"), ("u3", 1, 200, None, html(3), "html"),
            ("r4", 1, 302, "gone", None, "html"),
            ("bad", 1, 503, None, None, "html"), ("bad", 2, 503, None, None, "html"),
            ("text", 1, 200, None, "Document ID: D2\nDate: 05/06/2024\n", "text"),
        ],
        "url string, attempt int, status int, location string, body string, kind string",
    )
    final = H.final_attempts(log).cache()
    assert rows(final, "url", "final_url", "status", "retries") == [
        ("bad", "bad", 503, 1), ("r3", "u3", 200, 0), ("r4", "gone", None, 0), ("text", "text", 200, 0), ("u1", "u1", 200, 1), ("u2", "u2", 200, 1)
    ]
    docs = {r.document_id: r for r in H.documents(final).collect()}
    assert (docs["D1"].revision, docs["D1"].url, str(docs["D1"].published_date)) == (3, "r3", "2024-01-03")
    assert str(docs["D2"].published_date) == "2024-06-05"
    assert rows(H.failures(final)) == [("bad", 503, 1), ("r4", None, 0)]
    quality = ingest_quality(final).first()
    assert (quality.attempted, quality.succeeded, quality.failed, quality.target_met) == (6, 4, 2, False)
