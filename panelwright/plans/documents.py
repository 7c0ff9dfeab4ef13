"""Document ingest from an attempt log: final attempts, metadata, clean table, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.cleaning import parse_date_multi
from panelwright.operators.latest import latest_by

META = ["document_id", "title", "published", "agency", "document_type", "revision"]


def final_attempts(log: DataFrame) -> DataFrame:
    """Last attempt per URL, with one redirect hop followed to its target.

    A URL that was only fetched as a redirect target is reported under the URL that led there.
    """
    packed = F.struct("attempt", "status", "location", "body", "kind")
    last = log.groupBy("url").agg(F.max_by(packed, "attempt").alias("a"), F.max("attempt").alias("tries"))
    flat = last.select("url", "a.status", "a.location", "a.body", "a.kind", (F.col("tries") - 1).alias("retries"))
    hops = flat.where(F.col("location").isNotNull()).select("url", "location", "retries")
    direct = flat.where(F.col("location").isNull()).drop("location")
    arrived = hops.join(
        direct.select(F.col("url").alias("location"), "status", "body", "kind", F.col("retries").alias("_more")), "location", "left"
    ).select(
        "url", F.col("location").alias("final_url"), "status", "body", "kind",
        (F.col("retries") + F.coalesce("_more", F.lit(0))).alias("retries"),
    )
    targets = hops.select(F.col("location").alias("url"))
    stayed = direct.join(targets, "url", "left_anti").select("url", F.col("url").alias("final_url"), "status", "body", "kind", "retries")
    return stayed.unionByName(arrived)


def _blank_to_null(col: Column) -> Column:
    text = F.trim(col)
    return F.when(text != "", text)


def _first(body: Column, pattern: str) -> Column:
    return _blank_to_null(F.regexp_extract(body, pattern, 1))


def extract_html_meta(pages: DataFrame) -> DataFrame:
    """Metadata fields of HTML bodies. Text runs to the next tag or the end, so unclosed tags do
    no harm; an empty title is NULL and a missing revision is 1."""
    body = F.col("body")
    title = F.coalesce(_first(body, r"(?is)<title[^>]*>([^<]*)"), _first(body, r"(?is)<h1[^>]*>([^<]*)"))
    return pages.withColumns(
        {
            "document_id": _first(body, r'(?is)\bdata-id="([^"]*)"'),
            "title": title,
            "published": _first(body, r"(?is)<time[^>]*>([^<]*)"),
            "agency": _first(body, r'(?is)<span class="agency">([^<]*)'),
            "document_type": _first(body, r'(?is)<span class="doctype">([^<]*)'),
            "revision": F.coalesce(F.regexp_extract(body, r'(?is)\bdata-revision="(\d+)"', 1).try_cast("int"), F.lit(1)),
        }
    )


def extract_kv_meta(texts: DataFrame) -> DataFrame:
    """The same fields from ``Key: value`` lines of extracted text."""
    body = F.col("body")

    def line(key: str) -> Column:
        return _first(body, rf"(?im)^{key}:[ \t]*(.*)$")

    return texts.withColumns(
        {
            "document_id": line("Document ID"),
            "title": line("Title"),
            "published": line("Date"),
            "agency": line("Agency"),
            "document_type": line("Type"),
            "revision": F.coalesce(line("Revision").try_cast("int"), F.lit(1)),
        }
    )


def parsed(final: DataFrame) -> DataFrame:
    """Metadata of all successful bodies of either kind."""
    ok = final.where(F.col("status") == 200)
    html = extract_html_meta(ok.where(F.col("kind") == "html"))
    text = extract_kv_meta(ok.where(F.col("kind") == "text"))
    columns = ["url", "final_url", "status", *META]
    return html.select(*columns).unionByName(text.select(*columns))


def documents(final: DataFrame) -> DataFrame:
    """Clean document table with the highest revision per document id (ties: last URL)."""
    dated = parsed(final).where(F.col("document_id").isNotNull()).withColumn("published_date", parse_date_multi(F.col("published")))
    best = latest_by(dated, ["document_id"], "revision", "url")
    return best.select("document_id", "url", "title", "published_date", "agency", "document_type", "revision", "status")


def failures(final: DataFrame) -> DataFrame:
    """URLs that did not end in success."""
    failed = F.col("status").isNull() | (F.col("status") >= 400)
    return final.where(failed).select("url", "status", "retries")
