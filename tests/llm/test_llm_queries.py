"""The registered queries of this folder against their SQL, and columns that are fixed."""

from __future__ import annotations

import duckdb
import pytest
from check import TABLES, rows_of

import corpus_pipeline
from panelwright.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id size text_crc32 law shard slot grown_shard",
    "op2": "doc_id size source_size target taken",
    "op5": "doc_id held_out score predicted",
    "op8": "page_id url text n_chars",
    "op9": "source lang tokenizer n_docs n_tokens",
    "op11": "word form root n n_near form_n",
    "op12": "query_id rank vec_id score",
    "op13": "doc_id leaf subroot root proof_sha256 folded_root verified",
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(SQL[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert got == want and got[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_one_row_per_document(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert set(COLUMNS.get(name.split("_")[0], "").split()) <= set(df.columns)
    rows = spark.read.parquet(f"{FOLDER}/{'pages' if name.startswith('op8') else 'documents'}.parquet").count()
    assert df.count() == rows or name.startswith("op9") and df.count() > 0


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "decontamination", "mixing", "sharding"]
