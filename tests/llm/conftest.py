from __future__ import annotations

import pytest
from llm_data import DOCS


@pytest.fixture(scope="session")
def table(spark):
    """DataFrame of (doc_id, text, source) rows with further columns whose names clash with internal ones."""

    def build(rows: list[tuple]):
        full = [(i, t, None, s, len(t or ""), -1, -2, "k", -3, "h", "v") for i, t, s in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return build
