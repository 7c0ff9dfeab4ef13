"""Registered queries of this folder and the SQL that those are checked against which SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import decontamination, html_extraction, merkle, mixing, near_duplicates, oracles, quality_rules, sharding, spelling, surrogates, token_rollup, topk, toxicity, url_filters
from panelwright.runtime import stage_root

SHARDS = 24

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document after deobfuscation."""
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger of every document under the production policy."""
    return quality_rules.verdicts(quality_rules.ledger(table(spark, folder, "documents")))


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, equal texts together."""
    return sharding.digest(sharding.sharded(table(spark, folder, "documents"), SHARDS))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix of the sources by weights 1, 2, 3 takes of every document."""
    return mixing.taken(table(spark, folder, "documents"))


def op3_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its personal data replaced."""
    return surrogates.pseudonymized(table(spark, folder, "documents"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document inside windows of the whole benchmark."""
    return decontamination.digest(decontamination.hits(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def op7_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose sets of two-word shingles are similar to 80 percent."""
    how = near_duplicates.Similarity(size=2, percent=80)
    return near_duplicates.near_duplicates(table(spark, folder, "documents"), how).drop("text_hash")


def op8_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_extraction.extracted(table(spark, folder, "pages"))


def op9_token_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Token totals after three batches, two of them sent twice.

    All documents are added; those labelled low in quality are removed; those that repeat lines are
    rewritten without the repetitions.
    """
    docs = table(spark, folder, "documents")
    low = table(spark, folder, "labels").where("quality = 0")
    lines = F.split("text", "\n")
    rewritten = docs.withColumn("_lines", lines).where(F.size(F.array_distinct("_lines")) < F.size("_lines"))
    rewritten = rewritten.join(low, "doc_id", "left_anti").withColumn("text", F.array_join(F.array_distinct("_lines"), "\n"))
    ledger = token_rollup.Rollup(spark, f"{stage_root(spark)}/rollup-{uuid.uuid4().hex}")
    for _ in range(2):
        ledger.commit("1-load", changed=docs, new_ids=True)
        ledger.commit("2-remove", removed=low)
    ledger.commit("3-rewrite", changed=rewritten)
    return ledger.totals()


URL_RULES = [
    url_filters.Rule("allow", "com", "/"),
    url_filters.Rule("block", "example.com", "/en/"),
    url_filters.Rule("allow", "www.example.com", "/en/"),
    url_filters.Rule("block", "net", "/es/"),
    url_filters.Rule("block", "net", "/fr/"),
]


def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's URL under the rules, blocks carried to aliases."""
    return url_filters.verdicts(table(spark, folder, "pages"), url_filters.rule_table(spark, URL_RULES))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents, a few of them maimed, with their near words, forms and roots."""
    return spelling.variants(spelling.vocabulary(table(spark, folder, "documents"), mutate=199))


def op12_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The five best products of every fiftieth vector with all others."""
    return topk.top_k(table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("id") % 50 == 0)


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in the manifest, and the root after its line ends are lost in half of the documents."""
    docs = table(spark, folder, "documents")
    torn = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.manifest(docs, {"text": torn})


QUERIES: dict[str, Query] = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_html_extraction": op8_html_extraction,
    "op9_token_rollup": op9_token_rollup,
    "op10_url_filters": op10_url_filters,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_exact_top_k": op12_exact_top_k,
    "op13_merkle_manifest": op13_merkle_manifest,
}

SQL: dict[str, str] = {
    "op4_decontamination": oracles.DECONTAMINATION,
    "op6_quality_rules": oracles.QUALITY_RULES,
    "op7_minhash_near_dedup": oracles.NEAR_DUPLICATES,
    "op10_url_filters": oracles.URL_FILTERS,
    "op11_spelling_variants": oracles.SPELLING,
    "op12_exact_top_k": oracles.TOP_K,
    "op13_merkle_manifest": oracles.MERKLE,
}
