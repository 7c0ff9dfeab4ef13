"""Words that differ in one code point, by search schemes on bidirectional FM-indexes.

1. Words are counted in the JVM.
2. Two words at distance one agree on the first or on the last half of either of them, and a word has at least
   ``MIN_LENGTH`` code points, so they agree on the first or the last ``KEY`` ones. Vocabulary and queries meet in cells of
   words with equal first (or last) code points. Cells hold about ``CELL`` code points: small groups share one, a group that is
   larger is cut by hash, and its parts meet in a grid.
3. A cell's words, sorted and delimited, are one cyclic text, indexed forwards and backwards (``Index``). A pattern is
   a synchronized pair of rank intervals and can grow on either side.
4. A word's exact half is matched from its inner end out to the delimiter; then the pattern grows across the other
   half with one insertion, deletion or replacement, up to the delimiter. Only symbols that occur in the interval
   are tried. The rank of ``delimiter + word`` among the rotations is the word's number, so nothing is located.
   Each neighbour is found once: of equal neighbouring letters the last one is inserted or deleted, and
   the second scheme leaves out what agrees on the first half.

Defined results: NULL texts have no words; a NULL id deletes nothing; words hold no U+0000; an empty table has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import picked
from panelwright.operators.passes import Walk, ordered_pass
from panelwright.runtime import stage

MIN_LENGTH = 6
KEY = MIN_LENGTH // 2
CELL = 1 << 19
CHUNK = 4096  # queries whose states are held at once
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[a-zÀ-ÿ]+"


class Ranks:
    """Wavelet matrix of a sequence of symbols: ranks of a symbol, numbers of smaller ones, symbols of an interval."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.bits = max(1, int(sigma - 1).bit_length())
        self.zeros, self.middle = [], []
        for b in range(self.bits - 1, -1, -1):
            one = (symbols >> b) & 1
            zeros = np.zeros(len(symbols) + 1, dtype=np.int32)
            np.cumsum(1 - one, out=zeros[1:])
            self.zeros.append(zeros)
            self.middle.append(int(zeros[-1]))
            symbols = np.concatenate([symbols[one == 0], symbols[one == 1]])
        counts = np.bincount(symbols, minlength=1 << self.bits)
        self.before = np.cumsum(counts) - counts  # symbols smaller than c in the whole sequence
        start = np.zeros(1 << self.bits, dtype=np.int64)  # place of c's run in the last level
        first = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        start[symbols[first]] = first
        self.start = start

    def step(self, c: np.ndarray, at: np.ndarray, width: np.ndarray):
        """For symbols ``c`` of intervals: the interval of c put before, its width, and how many symbols there are smaller."""
        lo, hi, less = at, at + width, np.zeros(len(at), dtype=np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            zeros = self.zeros[level]
            zlo, zhi = zeros[lo], zeros[hi]
            one = ((c >> b) & 1).astype(bool)
            less += np.where(one, zhi - zlo, 0)
            lo = np.where(one, self.middle[level] + lo - zlo, zlo)
            hi = np.where(one, self.middle[level] + hi - zhi, zhi)
        return self.before[c] + lo - self.start[c], hi - lo, less

    def children(self, at: np.ndarray, width: np.ndarray):
        """Every symbol of every interval: number of the interval, symbol, and what ``step`` tells."""
        lo, hi = at.astype(np.int64), (at + width).astype(np.int64)
        who, c, less = np.arange(len(at)), np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        for level in range(self.bits):
            zeros = self.zeros[level]
            zlo, zhi = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
            left, right = zhi > zlo, (hi - zhi) > (lo - zlo)
            who, c, less, lo, hi = (
                np.concatenate([who[left], who[right]]),
                np.concatenate([c[left] * 2, c[right] * 2 + 1]),
                np.concatenate([less[left], (less + zhi - zlo)[right]]),
                np.concatenate([zlo[left], (self.middle[level] + lo - zlo)[right]]),
                np.concatenate([zhi[left], (self.middle[level] + hi - zhi)[right]]),
            )
        return who, c, self.before[c] + lo - self.start[c], hi - lo, less


def sorted_rotations(text: np.ndarray, sigma: int) -> np.ndarray:
    """Starts of the rotations of a text in order, by doubling; the text is no repetition of a shorter one."""
    n, bits = len(text), max(1, int(sigma - 1).bit_length())
    known = min(60 // bits, 8)
    key = np.zeros(n, dtype=np.int64)
    for k in range(known):
        key = (key << bits) | np.roll(text, -k)
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]])
        if rank[order[-1]] == n - 1:
            return order
        key = rank * n + np.roll(rank, -known)
        known *= 2


@dataclass
class Spans:
    """Patterns as synchronized intervals: start among the rotations, start among those of the reversed text, width."""

    at: np.ndarray
    back: np.ndarray
    width: np.ndarray

    def take(self, index: np.ndarray) -> Spans:
        return Spans(self.at[index], self.back[index], self.width[index])

    @staticmethod
    def joined(parts: list[Spans]) -> Spans:
        return Spans(*[np.concatenate([getattr(p, f) for p in parts]) for f in ("at", "back", "width")])


class Index:
    """Bidirectional FM-index of sorted distinct words, each after a delimiter (symbol 0), as a cyclic text."""

    def __init__(self, words: list[str]) -> None:
        points = np.frombuffer(("\0" + "\0".join(words)).encode("utf-32-le"), dtype=np.uint32)
        self.alphabet, text = np.unique(points, return_inverse=True)
        text = text.astype(np.int64)
        self.n, sigma = len(text), len(self.alphabet)
        order = sorted_rotations(text, sigma)
        self.leftward = Ranks(text[order - 1], sigma)
        mirrored = text[::-1].copy()
        order = sorted_rotations(mirrored, sigma)
        self.rightward = Ranks(mirrored[order - 1], sigma)

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """Code points as symbols; -1 for those that are in no word."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at, -1)

    def whole(self, n: int) -> Spans:
        return Spans(np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, self.n, np.int64))

    def grown(self, spans: Spans, c: np.ndarray, right: bool) -> tuple[np.ndarray, Spans]:
        """Patterns with symbol ``c`` put at one side, for those that occur: which, and their intervals."""
        known = np.flatnonzero(c >= 0)
        spans, c = spans.take(known), c[known]
        if right:
            back, width, less = self.rightward.step(c, spans.back, spans.width)
            out = Spans(spans.at + less, back, width)
        else:
            at, width, less = self.leftward.step(c, spans.at, spans.width)
            out = Spans(at, spans.back + less, width)
        alive = np.flatnonzero(width > 0)
        return known[alive], out.take(alive)

    def followers(self, spans: Spans, right: bool) -> tuple[np.ndarray, np.ndarray, Spans]:
        """Every symbol that occurs at one side: number of the pattern, symbol, interval."""
        if right:
            who, c, back, width, less = self.rightward.children(spans.back, spans.width)
            return who, c, Spans(spans.at[who] + less, back, width)
        who, c, at, width, less = self.leftward.children(spans.at, spans.width)
        return who, c, Spans(at, spans.back[who] + less, width)


class Queries:
    """Words as symbols, read from the split outwards: the exact half inwards out, then the other half."""

    def __init__(self, index: Index, words: list[str], right: bool) -> None:
        """``right``: the left half is exact and the pattern grows to the right."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        self.flat = index.symbols(points)
        self.length = np.array([len(w) for w in words])
        self.start = np.cumsum(self.length) - self.length
        self.split = self.length // 2
        self.right = right
        self.half = self.length - self.split if right else self.split  # length of the half with the error

    def exact(self, q: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The j-th symbol of the exact half, from the split outwards; 0 (the delimiter) after its end."""
        size = self.length[q] - self.half[q]
        at = self.start[q] + (self.split[q] - 1 - j if self.right else self.split[q] + j)
        return np.where(j < size, self.flat[np.clip(at, 0, len(self.flat) - 1)], 0)

    def other(self, q: np.ndarray, j: np.ndarray) -> np.ndarray:
        at = self.start[q] + (self.split[q] + j if self.right else self.split[q] - 1 - j)
        return np.where(j < self.half[q], self.flat[np.clip(at, 0, len(self.flat) - 1)], 0)


def neighbours(index: Index, queries: Queries, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, number of the word) whose difference lies in the half that is not exact."""
    right = queries.right
    spans, pending = index.whole(len(q)), np.arange(len(q))
    ready, found = [], []
    j = 0
    while len(pending):  # the exact half and its delimiter
        here = q[pending]
        size = queries.length[here] - queries.half[here]
        kept, spans = index.grown(spans, queries.exact(here, np.full(len(here), j)), not right)
        pending, done = pending[kept], size[kept] == j
        ready.append((pending[done], spans.take(np.flatnonzero(done))))
        pending, spans = pending[~done], spans.take(np.flatnonzero(~done))
        j += 1
    who = q[np.concatenate([p for p, _ in ready])] if ready else q[:0]
    spans = Spans.joined([s for _, s in ready]) if ready else index.whole(0)

    hits_q, hits_w = [], []
    err_q, err_j, err = who[:0], who[:0], spans.take(who[:0])
    j = 0
    while len(who) or len(err_q):
        kept, err = index.grown(err, queries.other(err_q, err_j), right)  # after the last symbol: the delimiter
        err_q, err_j = err_q[kept], err_j[kept]
        over = err_j == queries.half[err_q]
        hits_q.append(err_q[over])
        hits_w.append(err.at[over])
        err_q, err_j, err = err_q[~over], err_j[~over] + 1, err.take(np.flatnonzero(~over))
        if len(who):
            here = queries.other(who, np.full(len(who), j))
            after = queries.other(who, np.full(len(who), j + 1))
            inside = queries.half[who] > j
            parent, c, grown = index.followers(spans, right)
            odd = np.flatnonzero((c != here[parent]) & (c > 0))
            swap = odd[inside[parent[odd]]]
            gone = np.flatnonzero(inside & ((here != after) | (queries.half[who] == j + 1)))
            err = Spans.joined([err, grown.take(odd), grown.take(swap), spans.take(gone)])
            err_q, err_j = (
                np.concatenate([err_q, who[parent[odd]], who[parent[swap]], who[gone]]),
                np.concatenate([err_j, np.full(len(odd), j), np.full(len(swap), j + 1), np.full(len(gone), j + 1)]),
            )
            on = np.flatnonzero(inside)
            kept, spans = index.grown(spans.take(on), here[on], right)
            who = who[on[kept]]
        j += 1
    found = np.concatenate(hits_q) if hits_q else who, np.concatenate(hits_w) if hits_w else who
    return found


def _cell(right: bool):
    def run(_, vocabulary: pa.Table, asked: pa.Table) -> Iterator[pa.RecordBatch]:
        order = sorted(range(vocabulary.num_rows), key=vocabulary.column("word").to_pylist().__getitem__)
        vocabulary = vocabulary.take(pa.array(order, pa.int64()))
        words, words_n = vocabulary.column("word").to_pylist(), vocabulary.column("n").to_numpy()
        asked_words = asked.column("word").to_pylist()
        out = {"word": [], "near": [], "near_n": []}
        if words and asked_words:
            index = Index(words)
            queries = Queries(index, asked_words, right)
            for start in range(0, len(asked_words), CHUNK):
                q, w = neighbours(index, queries, np.arange(start, min(start + CHUNK, len(asked_words))))
                pairs = [(asked_words[a], words[b], n) for a, b, n in zip(q.tolist(), w.tolist(), words_n[w].tolist(), strict=True)]
                if not right:  # what agrees on the first half has been found by the other scheme
                    pairs = [p for p in pairs if not p[1].startswith(p[0][: len(p[0]) // 2])]
                out["word"] += [p[0] for p in pairs]
                out["near"] += [p[1] for p in pairs]
                out["near_n"] += [p[2] for p in pairs]
        return pa.table({"word": pa.array(out["word"], pa.string()), "near": pa.array(out["near"], pa.string()), "near_n": pa.array(out["near_n"], pa.int64())})

    return run


def _scheme(words: DataFrame, right: bool) -> DataFrame:
    """Pairs that agree on the half of the query at one side."""
    group = F.substring("word", 1, KEY) if right else F.substring("word", -KEY, KEY)
    keyed = words.withColumn("g", group).withColumn("size", F.length("word") + 1)
    sizes = keyed.groupBy("g").agg(F.sum("size").alias("chars"))
    placed = ordered_pass(sizes, Walk([], sums=["chars"]), [F.col("g")])
    cells = placed.select(
        "g",
        F.expr(f"(running_chars - chars) div {CELL}").alias("cell"),
        F.expr(f"cast((chars + {CELL} - 1) div {CELL} as int)").alias("parts"),
    ).withColumn("split", F.when(F.col("parts") > 1, F.col("g")).otherwise(""))
    dealt = stage(keyed.join(cells, "g").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")))
    all_parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    vocabulary = dealt.select("cell", "split", F.col("part").alias("i"), all_parts.alias("j"), "word", "n")
    asked = dealt.select("cell", "split", all_parts.alias("i"), F.col("part").alias("j"), "word")
    by = ["cell", "split", "i", "j"]
    asked = asked.toDF(*asked.columns)  # columns of its own
    return vocabulary.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(_cell(right), "word string, near string, near_n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """All ordered pairs ``word``, ``near``, ``near_n`` that differ by one inserted, deleted or replaced code point.

    ``words`` has distinct ``word`` of at least ``MIN_LENGTH`` code points and their number ``n``.
    """
    return _scheme(words, True).union(_scheme(words, False))


def vocabulary(docs: DataFrame, least: int = 5, mutate: int | None = None) -> DataFrame:
    """``word`` and ``n`` of the words of all texts: runs of letters, A-Z lower-cased, of ``MIN_LENGTH`` code points or more.

    ``mutate``: where this number divides the crc32 of ``<doc_id>:<run>``, the run loses the code point at crc32 % length.
    """
    rows = picked(docs, id="doc_id", text="text")
    runs = rows.select("id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({RUN})"), F.lit(1))).alias("run"))
    word = F.col("run")
    if mutate:
        runs = runs.withColumn("h", F.crc32(F.concat(F.col("id").cast("string"), F.lit(":"), "run").cast("binary")))
        cut = (F.col("h") % F.length("run")).cast("int")
        lost = F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.length("run")))
        word = F.when(F.col("h") % mutate == 0, lost).otherwise(F.col("run"))
    long = runs.where(F.length("run") >= MIN_LENGTH).select(word.alias("word")).where(F.length("word") >= MIN_LENGTH)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and the end ``root`` of its chain of ``form``; chains are free of circles, each round doubles the step."""
    now = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stage(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """Every word with its number of near words, its form (the most frequent near word, if ``ratio`` times as frequent) and its root."""
    words = stage(words.select("word", "n"))
    best = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best"))
    seen = stage(words.join(best, "word", "left"))
    formed = (-F.col("best.minus")) >= ratio * F.col("n")
    seen = seen.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.minus")).alias("form_n"),
    )
    ends = roots(seen.where("form IS NOT NULL"))
    return seen.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
