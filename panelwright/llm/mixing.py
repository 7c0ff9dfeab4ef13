"""Mixing sources to target weights in blocks of words.

The words of each source are laid end to end and cut into blocks of fixed length. Each output
shard draws its number of blocks per source from a multinomial law over what the sources still
owe, so shards vary at random and the totals end on target. A source's j-th draw maps to block
``permutation(j mod blocks)`` of its pass j div blocks; the slots that result meet the blocks
by index in one join on (source, block).

The driver holds one row per source (names are a catalogue, not data) and ``SHARDS`` counts for
each. Offsets inside a source come from running totals over range partitions, so a source with
a third of all rows is spread over many tasks.

Defined results: NULL or empty texts have no words and are not taken; NULL is a source of its own,
last in order; repeated rows and NULL ids are each taken for themselves; without any word all
targets are 0; columns other than id, source and text are not read (``mixed`` returns all).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import picked, word_array
from panelwright.operators.ordered import running_total
from panelwright.runtime import stage

BLOCK_WORDS = 64
SHARDS = 64
REPEATS = 3
SEED = 20_240_607
SLOTS_PER_TASK = 1_000_000


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: float
    blocks: int
    draws: int


def targets(sizes: list[int], weights: list[float], repeats: int = REPEATS) -> list[float]:
    """Shares of the total by weight; what exceeds ``repeats`` times a size is shared among the rest."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        unit = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / unit > repeats * sizes[k]]
        if not over:
            for k in open_:
                out[k] = left * weights[k] / unit
            break
        fixed = 0.0
        for k in sorted(over):
            out[k] = float(repeats * sizes[k])
            fixed += out[k]
            open_.discard(k)
        left -= fixed
    return out


class Permutation:
    """A pseudorandom permutation of range(n) by a keyed Feistel network with cycle walking."""

    def __init__(self, n: int, key: int) -> None:
        self.n = n
        self.half = max(1, ((n - 1).bit_length() + 1) // 2)
        self.keys = np.random.default_rng([SEED, key]).integers(1, 2**63, 4).astype(np.uint64)

    def _round(self, half: np.ndarray, key: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            y = (half + key) * np.uint64(0x9E3779B97F4A7C15)
            y = (y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (y ^ (y >> np.uint64(32))) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        low = np.uint64(self.half)
        left, right = x >> low, x & np.uint64((1 << self.half) - 1)
        for k in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ self._round(left, k), left
            else:
                left, right = right, left ^ self._round(right, k)
        return (left << low) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(x.astype(np.uint64), back)
        while (outside := out >= np.uint64(self.n)).any():
            out[outside] = self._once(out[outside], back)
        return out.astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, False)

    def place(self, x: np.ndarray) -> np.ndarray:
        """Where the permutation has ``x``."""
        return self._walk(x, True)


def draws_for(target: float, size: int, block_words: int, key: int) -> tuple[int, int]:
    """Blocks of a source, and draws whose words come nearest the target: whole passes, then blocks."""
    if size == 0:
        return 0, 0
    blocks = -(-size // block_words)
    passes = min(int(target // size), REPEATS)
    if passes == REPEATS:
        return blocks, REPEATS * blocks
    rest = target - passes * size
    short = blocks * block_words - size  # words that the last block lacks
    more = min(int(rest // block_words), blocks)
    options = [k for k in (more, more + 1, more + 2) if k <= blocks]
    last = int(Permutation(blocks, key).place(np.array([blocks - 1]))[0])  # the draw that meets the short block

    def words(k: int) -> int:
        return k * block_words - (short if k > last or k == blocks else 0)

    best = min(options, key=lambda k: (abs(words(k) - rest), k))
    return blocks, passes * blocks + best


def catalogue(rows: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> list[Source]:
    """The sources by code point, NULL last, with sizes, targets and numbers of draws."""
    found = [(r["source"], r["size"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    found.sort(key=lambda s: (s[0] is None, s[0] or ""))
    aims = targets([n for _, n in found], [weights[k % len(weights)] for k in range(len(found))])
    return [Source(name, size, aim, *draws_for(aim, size, block_words, k)) for k, ((name, size), aim) in enumerate(zip(found, aims, strict=True))]


def shard_counts(sources: list[Source], shards: int = SHARDS) -> np.ndarray:
    """Multinomial draws per shard and source; every source's draws add up to what it owes."""
    rng = np.random.default_rng(SEED)
    left = np.array([s.draws for s in sources], np.int64)
    out = np.zeros((shards, len(sources)), np.int64)
    total = int(left.sum())
    for shard in range(shards):
        open_slots = (total * (shard + 1)) // shards - (total * shard) // shards
        while open_slots:
            drawn = np.minimum(rng.multinomial(open_slots, left / left.sum()), left)
            out[shard] += drawn
            left -= drawn
            open_slots -= int(drawn.sum())
    return out


def slots(spark: SparkSession, sources: list[Source], shards: int = SHARDS) -> DataFrame:
    """Every slot of the mix: ``shard``, ``slot`` in it, ``src``, ``epoch`` (pass) and ``block``."""
    counts = shard_counts(sources, shards)
    total = int(counts.sum())
    before = np.concatenate([[0], np.cumsum(counts.reshape(-1))])
    earlier = np.cumsum(counts, axis=0) - counts
    blocks = [s.blocks for s in sources]
    sent = spark.sparkContext.broadcast((before, earlier, blocks))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, earlier, blocks = sent.value
        width = len(blocks)
        order = [Permutation(n, k) if n else None for k, n in enumerate(blocks)]
        for batch in batches:
            g = batch["id"].to_numpy()
            cell = np.searchsorted(before, g, side="right") - 1
            shard, src = cell // width, cell % width
            j = earlier[shard, src] + g - before[cell]
            epoch, block = np.empty_like(j), np.empty_like(j)
            for k in np.unique(src):
                own = src == k
                epoch[own] = j[own] // blocks[k]
                block[own] = order[k](j[own] % blocks[k])
            yield pd.DataFrame({"shard": shard, "slot": g - before[shard * width], "src": src, "epoch": epoch, "block": block})

    tasks = max(spark.sparkContext.defaultParallelism, -(-total // SLOTS_PER_TASK))
    return spark.range(0, total, 1, tasks).mapInPandas(run, "shard long, slot long, src long, epoch long, block long")


def source_table(spark: SparkSession, sources: list[Source]) -> DataFrame:
    order = sorted(range(len(sources)), key=lambda k: (sources[k].name is not None, sources[k].name or ""))  # as Spark sorts
    start, at = {}, 0
    for k in order:
        start[k] = at
        at += sources[k].size
    return spark.createDataFrame(
        [(s.name, k, s.size, s.target, start[k]) for k, s in enumerate(sources)],
        "source string, src long, source_size long, target double, start long",
    )


def pieces(rows: DataFrame, known: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The blocks that each row's words fall into: ``src``, ``block``, ``_row``, first word and words."""
    laid = running_total(rows.where("size > 0").select("source", "_mix", "_row", "size"), "size", [F.col("source"), F.col("_mix"), F.col("_row")])
    named = laid.join(known.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    begin = F.col("running") - F.col("size") - F.col("start")
    at = named.select("src", "_row", begin.alias("begin"), (begin + F.col("size")).alias("end"))
    cut = at.select(
        "*",
        F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor((F.col("end") - 1) / block_words))).alias("block"),
    )
    first = F.greatest("begin", F.col("block") * block_words)
    last = F.least("end", (F.col("block") + 1) * block_words)
    return cut.select("src", "block", "_row", (first - F.col("begin")).alias("first_word"), (last - first).alias("words"))


def counted(docs: DataFrame, keep_all: str = "") -> DataFrame:
    """The documents staged with their number of words, a row id and their place in the mix.

    The place is a hash of id and text, so that reruns on another layout of the files agree; the row
    id only parts repeated rows.
    """
    rows = docs.select("*") if keep_all else picked(docs, doc_id="doc_id", source="source", text="text")
    known = F.col("doc_id") if not keep_all else F.col(keep_all)
    rows = rows.withColumns(
        {"size": F.size(word_array(F.col("text"))).cast("long"), "_mix": F.xxhash64(known, "text"), "_row": F.monotonically_increasing_id()}
    )
    return stage(rows if keep_all else rows.drop("text"))


def taken(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """Per document its words, its source's words and target, and the words that the mix takes of it."""
    spark = docs.sparkSession
    rows = counted(docs)
    sources = catalogue(rows, block_words)
    known = source_table(spark, sources)
    drawn = slots(spark, sources, shards).groupBy("src", "block").agg(F.count(F.lit(1)).alias("draws"))
    used = pieces(rows, known, block_words).join(drawn, ["src", "block"])
    sums = used.groupBy("_row").agg(F.sum(F.col("words") * F.col("draws")).alias("taken"))
    named = rows.join(known.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    return named.join(sums, "_row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """The mix as documents: for each pass over a source the words that it takes of a document.

    A document of which a pass takes all words keeps its text as it is; else the taken words are
    joined by spaces. All columns are returned; ``n_chars``, if there is one, is counted anew.
    """
    spark = docs.sparkSession
    clash = {c: f"_in_{k}" for k, c in enumerate(docs.columns) if c not in ("text", "source")}
    rows = counted(docs.select(*[F.col(f"`{c}`").alias(clash.get(c, c)) for c in docs.columns]), keep_all=clash["doc_id"])
    sources = catalogue(rows, block_words)
    known = source_table(spark, sources)
    used = pieces(rows, known, block_words).join(slots(spark, sources, shards).select("src", "block", "epoch"), ["src", "block"])
    parts = used.groupBy("_row", "epoch").agg(F.sort_array(F.collect_list(F.struct("first_word", "words"))).alias("_parts"), F.sum("words").alias("_taken"))
    met = rows.join(parts.select("_row", "_parts", "_taken"), "_row")
    whole = F.col("_taken") == F.col("size")
    met = met.withColumn("_words", F.when(~whole, word_array(F.col("text"))))
    cut = F.transform("_parts", lambda p: F.slice("_words", (p["first_word"] + 1).cast("int"), p["words"].cast("int")))
    met = met.withColumn("text", F.when(whole, F.col("text")).otherwise(F.array_join(F.flatten(cut), " ")))
    out = []
    for c in docs.columns:
        if c == "n_chars":
            out.append(F.length("text").cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"`{clash.get(c, c)}`").alias(c))
    return met.select(*out)
