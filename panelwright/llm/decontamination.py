"""Benchmark decontamination by Wu-Manber search over words.

Every window of ``WINDOW`` words of a benchmark item (or the whole item, if shorter) is a pattern
whose letters are words. Patterns of one length share a shift table over blocks of two words
(one word for patterns of a single word): the block under the end of the search window says how
far the next possible end lies, and a block that ends some pattern leads to a bucket, keyed
further by the patterns' first block, whose entries are compared directly.

Documents are scanned where they lie, without a shuffle. The benchmark is the stated query set:
it is streamed through the driver in blocks of at most ``block_words`` item words, and only one
block is broadcast at a time, which bounds the broadcast whatever the size of the benchmark.
Results of several blocks are joined per document.

Defined results: NULL or empty texts have no words and are never hit; an item without words has
no windows; items that repeat an id count once; an item with a NULL id marks words but is not
listed; repeated documents are each returned; an empty benchmark hits nothing; columns other
than ids and texts are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import picked
from panelwright.runtime import stage

WINDOW = 10
BLOCK_WORDS = 500_000
#: On UTF-8 bytes: ASCII letters (lower-cased before) and digits, and whatever is not ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

HITS = "doc_id {id}, text_hash long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


#: Tables of one pattern length: the length, words of a block, shifts, and suffix block -> prefix
#: block -> pattern -> items. Plain containers, as they are broadcast.
Block = tuple[bytes, ...]
Buckets = dict[Block, dict[Block, dict[Block, set[str | None]]]]
Tables = tuple[int, int, dict[Block, int], Buckets]


def add(tables: Tables, pattern: Block, item: str | None) -> None:
    length, b, shift, buckets = tables
    for end in range(b, length + 1):
        block, far = pattern[end - b : end], length - end
        if far < shift.get(block, length - b + 1):
            shift[block] = far
    buckets.setdefault(pattern[-b:], {}).setdefault(pattern[:b], {}).setdefault(pattern, set()).add(item)


def search(tables: Tables, words: list[bytes]) -> Iterator[tuple[int, set[str | None]]]:
    """Start of every occurrence in order, with the items that own the pattern."""
    length, b, shift, buckets = tables
    default = length - b + 1
    end, n = length, len(words)
    while end <= n:
        block = tuple(words[end - b : end])
        far = shift.get(block, default)
        if far:
            end += far
            continue
        start = end - length
        for pattern, items in buckets[block].get(tuple(words[start : start + b]), {}).items():
            if all(words[start + k] == w for k, w in enumerate(pattern)):
                yield start, items
        end += 1


def windows(words: list[bytes], size: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    if 0 < len(words) < size:
        yield tuple(words)
    for i in range(len(words) - size + 1):
        yield tuple(words[i : i + size])


def build(patterns: Iterable[tuple[Block, str | None]]) -> list[Tables]:
    by_length: dict[int, Tables] = {}
    for pattern, item in patterns:
        n = len(pattern)
        add(by_length.setdefault(n, (n, min(2, n), {}, {})), pattern, item)
    return list(by_length.values())


def find(words: list[bytes], tables: list[Tables]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged spans of words inside occurrences, and the ids of the items that occur."""
    found: list[tuple[int, int]] = []
    items: set[str | None] = set()
    for table in tables:
        for start, owners in search(table, words):
            found.append((start, start + table[0]))
            items |= owners
    spans: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((start, end))
    return spans, {i for i in items if i is not None}


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[Tables]]:
    """Tables of consecutive parts of the benchmark; a long item is cut between windows."""
    part: list[tuple[tuple[bytes, ...], str | None]] = []
    for item, text in benchmark.select("item_id", "text").toLocalIterator(prefetchPartitions=False):
        for pattern in windows(words_of(text)):
            part.append((pattern, item))
            if len(part) >= block_words:
                yield build(part)
                part = []
    if part:
        yield build(part)


def _scan(docs: DataFrame, tables) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            counts, spans, items = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                hit, ids = find(words, tables.value)
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in hit])
                items.append(sorted(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "text_hash", "n_words", "spans", "items"],
            )

    return docs.mapInArrow(run, HITS.format(id=docs.schema["doc_id"].dataType.simpleString()))


def hits(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document its words, the spans of hit words and the items whose windows occur."""
    spark: SparkSession = docs.sparkSession
    rows = picked(docs, doc_id="doc_id", text="text").withColumn("text_hash", F.xxhash64("text"))
    queries = picked(benchmark, item_id="item_id", text="text").withColumn("item_id", F.col("item_id").cast("string"))
    blocks = _blocks(queries, block_words)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return _scan(rows, spark.sparkContext.broadcast(first))
    parts = []
    for tables in _chained(first, second, blocks):
        sent = spark.sparkContext.broadcast(tables)
        parts.append(stage(_scan(rows, sent)))
        sent.destroy()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = every.groupBy("doc_id", "text_hash", "n_words").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.flatten(F.collect_list("items")).alias("items"),
        (F.count(F.lit(1)) / len(parts)).cast("int").alias("copies"),
    )
    return merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies")


def _chained(first: list[Tables], second: list[Tables], rest: Iterator[list[Tables]]) -> Iterator[list[Tables]]:
    yield first
    yield second
    yield from rest


def n_hit_words() -> Column:
    places = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))
    return F.size(F.array_distinct(places)).cast("long")


def digest(found: DataFrame) -> DataFrame:
    items = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit_words().alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without a hit, with all their columns; one pass over them per benchmark block."""
    spark: SparkSession = docs.sparkSession
    queries = picked(benchmark, item_id="item_id", text="text").withColumn("item_id", F.col("item_id").cast("string"))
    left, sent = docs, None
    for tables in _blocks(queries, block_words):
        if sent is not None:
            left = stage(left)
            sent.destroy()
        sent = spark.sparkContext.broadcast(tables)
        left = _clean(left, sent)
    return left


def _clean(docs: DataFrame, tables) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([not find(words_of(t.as_py()), tables.value)[0] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
