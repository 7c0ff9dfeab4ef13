"""Token totals kept up to date by signed deltas.

A batch of changes (documents added or rewritten, ids removed) becomes signed rows: what a
document now counts with +1, and what the ledger holds of it with -1. Their sums by source, language and
tokenizer version are the batch's delta, and totals are sums of deltas, so no document is counted
again. Each batch is committed once under its id: its rows are written first, its delta last, and
Spark's ``_SUCCESS`` mark of the delta is the commit. A batch that failed half-way is written anew, one
that is committed already is left alone, so batches may be sent any number of times.

Defined results: NULL and empty texts count 0 tokens in one document; runs of any length are encoded; NULL sources and languages
are groups of their own; rows that repeat an id within a batch each count, and a later change
replaces all of them; rows without an id count but can not be changed later; an empty batch is
committed with no delta; columns other than those named are not read.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import picked

FOLDER = "/opt/tokenizers"
#: Tokenizer version -> vocabulary file of ranks.
VERSIONS = {"byte-bpe-50k/1": "byte_bpe_50k.tiktoken"}
# Fixed value: the published pre-tokenizer pattern that the vocabularies were made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

GROUP = ["source", "lang", "tokenizer"]
ROW = "doc_id {id}, source string, lang string, tokenizer string, tokens long, sign long"


def ranks(version: str, folder: str = FOLDER) -> dict[bytes, int]:
    with open(os.path.join(folder, VERSIONS[version]), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: Runs of white space (as the pattern understands it) that are too long for its matcher.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2000,}")


def _encoder(vocabulary: dict[bytes, int]) -> Callable[[str], list[int]]:
    """Encoder of texts with runs of any length.

    The pattern takes all of a run of white space but its last sign, or the whole run where the text
    ends. Long runs are cut at these places beforehand and encoded as the single pieces they are, so the
    tokens are the same and the matcher, which walks back step by step, never sees them.
    """
    import tiktoken

    split = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={}).encode_ordinary
    whole: list[Callable[[str], list[int]]] = []

    def encode(text: str) -> list[int]:
        tokens, at = [], 0
        for run in LONG_SPACE.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            if not whole:
                pieces = tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=vocabulary, special_tokens={})
                whole.append(pieces.encode_ordinary)
            tokens += split(text[at : run.start()]) + whole[0](text[run.start() : end])
            at = end
        return tokens + split(text[at:]) if tokens else split(text)

    return encode


@dataclass(frozen=True)
class Rollup:
    """Ledger of token counts in a shared folder."""

    spark: SparkSession
    path: str
    tokenizer: str = "byte-bpe-50k/1"
    vocabularies: str = FOLDER

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def committed(self) -> list[str]:
        """Ids of the committed batches."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/deltas")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(n for n in names if self._exists(f"{self.path}/deltas/{n}/_SUCCESS"))

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{part}/{b}" for b in self.committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def counted(self, docs: DataFrame) -> DataFrame:
        """``doc_id``, ``source``, ``lang``, ``tokens`` of whole texts."""
        rows = picked(docs, doc_id="doc_id", source="source", lang="lang", text="text")
        vocabulary = self.spark.sparkContext.broadcast(ranks(self.tokenizer, self.vocabularies))  # its size is the vocabulary's

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode = _encoder(vocabulary.value)
            for batch in batches:
                n = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "tokens"])

        kind = rows.schema["doc_id"].dataType.simpleString()
        return rows.mapInArrow(run, f"doc_id {kind}, source string, lang string, tokens long")

    def held(self, ids: DataFrame) -> DataFrame:
        """What the ledger holds of the documents ``ids``: rows with the number of times each counts."""
        rows = self._read("rows", ROW.format(id=ids.schema["doc_id"].dataType.simpleString()))
        rows = rows.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        return rows.groupBy("doc_id", *GROUP, "tokens").agg(F.sum("sign").alias("sign")).where("sign != 0")

    def commit(self, batch: str, changed: DataFrame | None = None, removed: DataFrame | None = None, new_ids: bool = False) -> bool:
        """Commit a batch of documents added or rewritten and of ids removed; False if it was committed before.

        With ``new_ids`` the documents are known to be new, and the ledger is not searched for them.
        """
        if batch in self.committed():
            return False
        kind = (changed if changed is not None else removed).schema["doc_id"].dataType.simpleString()
        signed = self.spark.createDataFrame([], ROW.format(id=kind))
        gone = []
        if changed is not None:
            plus = self.counted(changed).withColumns({"tokenizer": F.lit(self.tokenizer), "sign": F.lit(1).cast("long")})
            signed = signed.unionByName(plus)
            if not new_ids:
                gone.append(changed.select("doc_id"))
        if removed is not None:
            gone.append(removed.select("doc_id"))
        if gone:
            ids = gone[0] if len(gone) == 1 else gone[0].union(gone[1])
            signed = signed.unionByName(self.held(ids).withColumn("sign", -F.col("sign")))
        signed.write.mode("overwrite").parquet(f"{self.path}/rows/{batch}")
        rows = self.spark.read.schema(ROW.format(id=kind)).parquet(f"{self.path}/rows/{batch}")
        delta = rows.groupBy(*GROUP).agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        delta.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/deltas/{batch}")
        return True

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer version over all committed batches."""
        deltas = self._read("deltas", "source string, lang string, tokenizer string, docs long, tokens long")
        return deltas.groupBy(*GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).where("n_docs != 0 OR n_tokens != 0")
