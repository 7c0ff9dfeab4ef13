"""Near-duplicate documents by SuperMinHash.

1. Per document the set of its word shingles, its SuperMinHash signature and the band hashes of
   the signature, computed in NumPy for a whole Arrow batch at a time. Documents with equal sets
   form one class; only classes go on, so copies are never compared.
2. Classes meet in buckets of equal band hashes. Every bucket is first compared with one leader,
   then with growing samples of leaders (a share 1/D of the classes, D falling to 1), each time only
   across classes that are not connected yet. With D = 1 every pair of a bucket has been compared or
   is connected, so no link between two classes of a bucket is lost, while a large group of copies
   is joined after a few leaders and never listed as pairs.
   Pairs whose sets differ in too many shingles are passed over by a sketch of parities, one bit
   for the shingles of each of 2,048 hash cells: two sketches never differ in more bits than the sets
   in shingles, so this drops no link.
3. Candidates are confirmed on the full sets. Pairs are dealt to a grid of cells, each of which gets
   the sets it needs once, so a set is not sent again for each of its pairs. Confirmed links are
   grouped by union-find inside partitions and then over the table (``graph.components``).

What grows faster than the input are comparisons of sketches (not rows, sets or memory) inside a bucket
of many different texts that resemble each other just below the threshold: to show that none of them
is linked takes a look at each pair.

With ``BANDS`` x ``ROWS`` = 32 x 5, two sets of similarity 0.8 share no bucket with probability
(1 - 0.8^5)^32 = 3e-6, sets of 0.85 with 2e-8.

Defined results: a text that is NULL or without words has an empty set and stands alone; a text of
one word has that word as its shingle; repeated rows and equal ids are returned each; a class
whose ids are all NULL has the component NULL; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import picked
from panelwright.llm.graph import components
from panelwright.runtime import stage

BANDS, ROWS = 32, 5
BITMAP_BITS = 26  # of the key: 8 MB, whatever the number of candidates
CELL_PAIRS = 20_000
SKETCH_BITS = 2048
LEADERS = 64  # times as many in each round as in the one before

_U = np.uint64
_RANDOM_BITS = _U(48)
_CHUNK = 200_000  # elements whose permutations are held at once


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered for up to a million words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; a shorter text is one shingle."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(each) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    run = mixed(each[: len(each) - size + 1] + _U(size))
    for k in range(1, size):
        run = mixed(run * _U(0x9E3779B97F4A7C15) + each[k : len(each) - size + 1 + k])
    return np.unique(run)


def superminhash(sets: list[np.ndarray], width: int) -> np.ndarray:
    """SuperMinHash signatures, one row per set; sets must not be empty.

    Every element visits the positions of the signature in its own random order (a Fisher-Yates
    shuffle that is advanced one step per round) and offers round + random there. The smallest
    offer stays. A set is ready when all its positions hold an offer of a finished round, which
    for large sets is after the first rounds.
    """
    out = np.empty((len(sets), width), np.uint64)
    start = 0
    while start < len(sets):
        end, total = start, 0
        while end < len(sets) and (end == start or total + len(sets[end]) <= _CHUNK):
            total += len(sets[end])
            end += 1
        out[start:end] = _signatures(sets[start:end], width)
        start = end
    return out


def _signatures(sets: list[np.ndarray], width: int) -> np.ndarray:
    best = np.full((len(sets), width), np.iinfo(np.uint64).max, np.uint64)
    flat = best.reshape(-1)
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = None
    with np.errstate(over="ignore"):
        for j in range(width):
            draw = mixed(element + _U(j + 1) * _U(0x9E3779B97F4A7C15))
            swap = (mixed(draw) % _U(width - j)).astype(np.int64) + j
            if j == 0:
                place = swap
            else:
                every = np.arange(len(element))
                place = order[every, swap].astype(np.int64)
                order[every, swap] = order[every, j]
            np.minimum.at(flat, owner * width + place, (_U(j) << _RANDOM_BITS) | (draw >> (_U(64) - _RANDOM_BITS)))
            open_sets = best.max(axis=1) >= (_U(j + 1) << _RANDOM_BITS)
            if not open_sets.any():
                break
            stay = open_sets[owner]
            if j == 0:
                element, owner, place = element[stay], owner[stay], place[stay]
                order = np.tile(np.arange(width, dtype=np.uint16), (len(element), 1))
                order[np.arange(len(element)), place] = 0
            elif stay.mean() < 0.7:
                element, owner, order = element[stay], owner[stay], order[stay]
    return best


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows)
    with np.errstate(over="ignore"):
        out = mixed(np.arange(1, bands + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))[None, :].repeat(len(parts), 0)
        for k in range(rows):
            out = mixed(out * _U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out.view(np.int64)


def parities(found: np.ndarray) -> np.ndarray:
    """Odd sketch of a set: the parity of the number of its hashes in each of 2,048 cells, as 32 numbers."""
    odd = np.bincount((found >> _U(53)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


@dataclass(frozen=True)
class Similarity:
    """Shingles of ``size`` words; linked if 100 * intersection >= ``percent`` * union."""

    size: int = 5
    percent: int = 80
    bands: int = BANDS
    rows: int = ROWS


def sketches(docs: DataFrame, how: Similarity) -> DataFrame:
    """Per row of ``doc_id``, ``text``: size of its set, key of the set and band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), how.size, hashes) for t in batch.column("text")]
            full = [k for k, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            if full:
                found = band_hashes(superminhash([sets[k] for k in full], how.bands * how.rows), how.bands, how.rows)
                for k, row in zip(full, found, strict=True):
                    bands[k] = row
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array([parities(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_hash", "n_shingles", "key", "bands", "odd"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, key binary, bands array<long>, odd array<long>")


def _bit(key):
    return F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A map of fixed size with the bit of every key set: what it lets through is checked by a join."""
    bits = keys.select(_bit("key").alias("b"))
    words = bits.groupBy(F.shiftright("b", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")
    )
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    found = words.toArrow()  # a row per 64 bits that hold one, so at most 2^20
    out[found["w"].to_numpy()] = found["v"].to_numpy()
    return out


def _sets(docs: DataFrame, wanted: DataFrame, how: Similarity) -> DataFrame:
    """``key`` and full set of the classes of ``wanted`` (key, doc_id), from one document each."""
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = WordHashes(), bitmap.value
        for batch in batches:
            ids, keys, sets = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = shingle_set(text.as_py(), how.size, hashes)
                if not len(found):
                    continue
                key = xxhash.xxh3_128_digest(found.tobytes())
                bit = int.from_bytes(key[:4], "big") & ((1 << BITMAP_BITS) - 1)
                if int(bits[bit >> 6]) >> (bit & 63) & 1:
                    ids.append(doc_id)
                    keys.append(key)
                    sets.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))],
                names=["doc_id", "key", "set"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key binary, set array<long>")
    one = found.join(
        wanted.select("key", F.col("doc_id").alias("_id")), (found["key"] == wanted["key"]) & F.col("doc_id").eqNullSafe(F.col("_id"))
    ).select(found["key"], "set")
    return stage(one.dropDuplicates(["key"]))


def _confirmed(pairs: DataFrame, sets: DataFrame, how: Similarity) -> DataFrame:
    """The pairs ``a``, ``b`` (staged) whose full sets are similar enough.

    Cells are a grid over hashes of both ends, so many that each has about ``CELL_PAIRS`` pairs; the
    pairs of one frequent end are spread over a row of the grid.
    """
    side = max(1, math.isqrt(pairs.count() // CELL_PAIRS) + 1)
    row, column = F.pmod(F.xxhash64("a"), F.lit(side)), F.pmod(F.xxhash64("b"), F.lit(side))
    dealt = pairs.select("a", "b", (row * side + column).alias("cell"))
    ends = dealt.select("cell", F.explode(F.array("a", "b")).alias("key")).distinct()
    sent = ends.join(sets, "key").select(F.col("cell").alias("to_cell"), "key", "set")

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        values = sets.column("set").combine_chunks()
        ends = values.offsets.to_numpy()
        flat = values.values.to_numpy().view(np.uint64)
        place = {k: flat[ends[i] : ends[i + 1]] for i, k in enumerate(sets.column("key").to_pylist())}
        keep = []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            one, other = place[a], place[b]
            at = np.searchsorted(one, other)
            at[at == len(one)] = 0
            common = int((one[at] == other).sum())
            keep.append(100 * common >= how.percent * (len(one) + len(other) - common))
        return pairs.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stage(dealt.groupBy("cell").cogroup(sent.groupBy("to_cell")).applyInArrow(run, "a binary, b binary"))


def _possible(one: str, other: str, n_one: str, n_other: str, how: Similarity) -> Column:
    """Whether sizes and parities allow the similarity: linked sets differ in few enough shingles."""
    differ = F.lit(0)
    for k in range(SKETCH_BITS // 64):
        differ = differ + F.bit_count(F.get(F.col(one), F.lit(k)).bitwiseXOR(F.get(F.col(other), F.lit(k))))
    total = F.col(n_one) + F.col(n_other)
    sizes = 100 * F.least(n_one, n_other) >= how.percent * F.greatest(n_one, n_other)
    return sizes & ((100 + how.percent) * differ <= (100 - how.percent) * total)


def _possible_pairs(pairs: DataFrame, known: DataFrame, how: Similarity) -> DataFrame:
    """The pairs ``a``, ``b`` that may be linked."""
    met = pairs.join(known.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa")), "a")
    met = met.join(known.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob")), "b")
    return met.where(_possible("oa", "ob", "na", "nb", how)).select("a", "b")


def _pair(one: str, other: str) -> list[Column]:
    return [F.greatest(one, other).alias("a"), F.least(one, other).alias("b")]


def class_links(docs: DataFrame, classes: DataFrame, how: Similarity) -> DataFrame:
    """Node and root of every class (``key``, ``doc_id``, ``n_shingles``, ``bands``, ``odd``) linked with another."""
    spread = classes.select("key", F.explode("bands").alias("h"))
    leaders = stage(spread.groupBy("h").agg(F.min("key").alias("lead"), F.count(F.lit(1)).alias("members")).where("members > 1"))
    members = stage(spread.join(leaders, "h").select("h", "key", "lead", "members"))
    known = stage(members.select("key").distinct().join(classes.select("key", "doc_id", F.col("n_shingles").alias("n"), "odd"), "key"))
    first = members.where("key != lead").select(*_pair("key", "lead")).distinct()
    sets = _sets(docs, known.select("key", "doc_id"), how)
    links = _confirmed(stage(_possible_pairs(first, known, how)), sets, how)
    groups = components(links)
    largest = leaders.agg(F.max("members")).first()[0] or 0
    members = members.where("members > 2").select("h", "key")
    share = 1
    while share * LEADERS < largest:
        share *= LEADERS
    while largest > 2 and share:
        rooted = known.select("key", "n", "odd").join(groups.withColumnRenamed("node", "key"), "key", "left")
        label = stage(members.join(rooted.withColumn("root", F.coalesce("root", "key")), "key"))
        split = stage(label.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("h", "lo"))
        open_rows = stage(label.join(split, "h"))
        # Of two components one is not the bucket's first, so in the last round the first leads nothing.
        leads = F.pmod(F.xxhash64("key"), F.lit(share)) == 0 if share > 1 else F.col("root") != F.col("lo")
        lead = open_rows.where(leads)
        lead = lead.select("h", *[F.col(c).alias(f"lead_{c}") for c in ("key", "n", "root", "odd")])
        across = (F.col("root") != F.col("lead_root")) & _possible("odd", "lead_odd", "n", "lead_n", how)
        pairs = stage(open_rows.join(lead, "h").where(across).select(*_pair("key", "lead_key")).distinct())
        more = _confirmed(pairs, sets, how)
        if not more.isEmpty():
            links = links.union(more)
            groups = components(links)
        share //= LEADERS
    return groups


def _grouped(docs: DataFrame, how: Similarity) -> DataFrame:
    """The rows of ``near_duplicates`` with the ``root`` of their component, NULL without words."""
    rows = picked(docs, doc_id="doc_id", text="text").withColumn("text_hash", F.xxhash64("text"))
    sketch = stage(sketches(rows, how))
    classes = stage(
        sketch.where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    )
    groups = class_links(rows, classes, how)
    rooted = classes.select("key", "doc_id").join(groups.withColumnRenamed("node", "key"), "key", "left")
    rooted = stage(rooted.select("key", "doc_id", F.coalesce("root", "key").alias("root")))
    smallest = stage(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    named = stage(rooted.join(smallest, "root").select("key", "root", "component_id"))
    alone = sketch.where("key IS NULL").withColumns({"component_id": F.col("doc_id"), "root": F.col("key")})
    columns = ["doc_id", "text_hash", "n_shingles", "component_id", "root"]
    grouped = sketch.where("key IS NOT NULL").join(named, "key").select(*columns)
    return grouped.unionByName(alone.select(*columns)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """Per row ``doc_id``, ``text_hash``, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept``."""
    return _grouped(docs, how).drop("root")


def keep_one(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns.

    Where texts of one group share the smallest id, or none has an id, the smallest text hash
    stays. Texts without words are groups of their own. A document is known by its id and text,
    so of rows that repeat both one is left.
    """
    found = _grouped(docs, how).where("kept").groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n_rows"))
    found = stage(found.select("root", F.struct("text_hash", "doc_id", "n_rows").alias("first")))
    # All kept rows of a component have the same id, so the hash alone decides among them.
    firsts = found.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("first")).select("first")
    firsts = firsts.union(found.where("root IS NULL").select("first"))
    stay = stage(firsts.select(F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash"), "first.n_rows"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(whole.alias("whole"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    single = packed.join(stay.where("n_rows = 1"), same, "left_semi")
    repeated = packed.join(stay.where("n_rows > 1"), same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return single.unionByName(repeated).select(*[F.col("whole").getField(c).alias(c) for c in docs.columns])
