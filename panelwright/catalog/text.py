"""Text classification and document ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.catalog.book import BOOK
from panelwright.catalog.ctes import with_
from panelwright.catalog.forecast import rounded
from panelwright.functions.cleaning import normalize_text
from panelwright.operators import latest
from panelwright.plans import documents as H
from panelwright.plans import text as X
from panelwright.runtime import stage
from panelwright.sources.derived import corpus, document_pages, sentiments
from panelwright.sources.tables import Tables

TERMS = """
corpus AS (
  SELECT d.doc_id, d.text, d.lang AS topic, d.source, CAST(quality AS VARCHAR) AS sentiment,
         CASE WHEN CAST(regexp_extract(source, '(\\d+)', 1) AS INT) % 5 = 0 THEN 'test' ELSE 'train' END AS split
  FROM documents d LEFT JOIN labels l USING (doc_id)),
toks AS (SELECT doc_id, split, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM corpus),
grams AS (SELECT doc_id, split, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS t FROM toks),
counts AS (SELECT doc_id, split, term, count(*) AS tf FROM (SELECT doc_id, split, unnest(t) AS term FROM grams) GROUP BY ALL)"""
VOCAB = """
vocab AS (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM counts WHERE split = 'train' GROUP BY 1 HAVING count(*) >= 2
  ORDER BY total DESC, term LIMIT 12000),
raw AS (
  SELECT doc_id, term, tf * (ln((1 + (SELECT CAST(count(*) AS DOUBLE) FROM corpus WHERE split = 'train')) / (1 + df)) + 1) AS raw
  FROM counts JOIN vocab USING (term)),
weights AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


def split_corpus(spark, folder):
    return X.group_split(corpus(Tables(spark, folder)), F.col("family"))


def model(spark, folder):
    return X.TextModel(split_corpus(spark, folder), max_terms=12_000)  # the published number of features


BOOK.add(
    "x01",
    lambda s, d: Tables(s, d).documents.select("doc_id", normalize_text(F.col("text")).alias("text")),
    "SELECT doc_id, trim(regexp_replace(lower(text), '[\\s\\v\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g')) AS text FROM documents",
)


def x02(spark, folder):
    return X.term_profile(Tables(spark, folder).documents, "doc_id", "text")


BOOK.add("x02", x02, with_(TERMS) + """
SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n_terms, count(*) AS n_distinct, CAST(sum(length(term) * tf) AS BIGINT) AS n_chars,
       min(term) AS first_term, max(tf) AS top_count FROM counts GROUP BY 1""")
BOOK.add("x03", lambda s, d: model(s, d).vocab.select("term", "df", "total"), with_(TERMS, VOCAB) + "SELECT term, df, total FROM vocab")
BOOK.add("x04", lambda s, d: rounded(model(s, d).weights), with_(TERMS, VOCAB) + "SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
BOOK.add("x05", lambda s, d: model(s, d).embedding)
BOOK.add(
    "x06",
    lambda s, d: split_corpus(s, d).select("doc_id", "source", "split"),
    with_(TERMS) + "SELECT doc_id, source, split FROM corpus",
)
BOOK.add(
    "x07",
    lambda s, d: X.check_split(split_corpus(s, d), "source"),
    with_(TERMS) + "SELECT count(*) FILTER (WHERE n > 1) = 0 AS passed, count(*) FILTER (WHERE n > 1) AS n_violations FROM (SELECT source, count(DISTINCT split) AS n FROM corpus GROUP BY 1)",
)


def labelled(spark, folder, m):
    """Stage table of embeddings with split and both labels: the classifiers read it several times."""
    rows = m.corpus.select("doc_id", "split", "topic").join(m.embedding, "doc_id")
    return stage(rows.join(sentiments(Tables(spark, folder)), "doc_id", "left"))


def x08(spark, folder):
    """Held-out accuracy and macro-F1 of both classifiers."""
    rows = labelled(spark, folder, model(spark, folder))
    out = None
    for label in ("topic", "sentiment"):
        made = X.train_classifier(rows, label).where(F.col("split") == "test")
        row = X.classification_metrics(made, "actual", "pred").withColumn("label", F.lit(label))
        out = row if out is None else out.unionByName(row)
    return out


def x09(spark, folder):
    guess = F.when(F.col("doc_id") % 7 == 0, "en").when(F.col("doc_id") % 11 == 0, "other").otherwise(F.col("lang"))
    rows = Tables(spark, folder).documents.select("lang", guess.alias("guess"))
    return rounded(X.classification_metrics(rows, "lang", "guess"))


def x10(spark, folder):
    m = model(spark, folder)
    rows = labelled(spark, folder, m)
    made = X.predictions(X.train_classifier(rows, "topic"), X.train_classifier(rows, "sentiment"))
    return made.join(X.embeddings_wide(m.embedding, m.components.shape[1]), "doc_id")


BOOK.add("x08", x08)
BOOK.add("x09", x09, """
WITH g AS (SELECT lang AS a, CASE WHEN doc_id % 7 = 0 THEN 'en' WHEN doc_id % 11 = 0 THEN 'other' ELSE lang END AS p FROM documents),
classes AS (SELECT a AS c FROM g UNION SELECT p FROM g),
f AS (SELECT c, (SELECT count(*) FROM g WHERE a = c AND p = c) AS tp, (SELECT count(*) FROM g WHERE a = c) AS na, (SELECT count(*) FROM g WHERE p = c) AS np FROM classes)
SELECT round(CAST(sum(tp) AS DOUBLE) / sum(na), 6) AS accuracy, round(avg(2 * tp / CAST(na + np AS DOUBLE)), 6) AS macro_f1, CAST(sum(na) AS BIGINT) AS n FROM f""")
BOOK.add("x10", x10)

# -- documents ------------------------------------------------------------------------------------------

DOCS = r"""
meta AS (
  SELECT url, nullif(coalesce(nullif(regexp_extract(url, '://[^/?#]*/[^?#]*?(\d+)', 1), ''), CAST(page_id AS VARCHAR)), '') AS document_id,
         nullif(trim(regexp_extract(html, '<title>([^<]*)', 1, 's')), '') AS title, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS published,
         nullif(regexp_extract(url, '://([^/?#]+)', 1), '') AS agency, nullif(regexp_extract(url, '://[^/?#]+/([a-z]+)/', 1), '') AS document_type,
         CAST(page_id AS INT) AS revision FROM pages LEFT JOIN orders ON o_orderkey = page_id)"""


def pages_of(spark, folder, kind: str) -> DataFrame:
    return document_pages(Tables(spark, folder)).where(F.col("kind") == kind)


META_SQL = "document_id, title, published, agency, document_type, revision"
for _name, _kind, _read in (("h02", "html", H.extract_html_meta), ("h03", "text", H.extract_kv_meta)):
    BOOK.add(
        _name,
        lambda s, d, kind=_kind, read=_read: read(pages_of(s, d, kind)).select("url", *H.META),
        with_(DOCS) + f"SELECT url, {META_SQL} FROM meta",
    )
BEST = "(SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY revision DESC, url DESC) AS rn FROM meta)"
BOOK.add(
    "h04",
    lambda s, d: H.documents(
        document_pages(Tables(s, d))
        .where(F.col("kind") == F.when(F.crc32(F.col("url").cast("binary")) % 2 == 0, "html").otherwise("text"))  # either layer of a page
        .withColumns({"final_url": F.col("url"), "status": F.lit(200)})
    ),
    with_(DOCS) + f"SELECT document_id, url, title, published AS published_date, agency, document_type, revision, 200 AS status FROM {BEST} WHERE rn = 1",
)
BOOK.add(
    "d04",
    lambda s, d: latest.latest_by(H.extract_html_meta(pages_of(s, d, "html")), ["document_id"], "revision", "url").select("document_id", "url", "revision"),
    with_(DOCS) + f"SELECT document_id, url, revision FROM {BEST} WHERE rn = 1",
)
