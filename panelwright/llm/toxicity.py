"""Toxicity of texts that try to hide it.

1. A character language model is counted over the words of all documents: trigrams of the 26 base
   letters and the word border, so the model has at most 27^3 counts however large the corpus.
2. Tokens with any digits or signs among letters, doubled or stretched letters, or single letters
   spaced out are restored, beside the form they are written in: every character opens a few letters (itself, the letters that it can stand for, or
   nothing where it repeats or separates), and Viterbi decoding picks the likeliest path under the
   model and the costs of the channel. Among letters that stand apart a word may begin at each of
   them, at the price that the model has for a border.
3. The words and word beginnings that mark toxic documents are learnt from labelled documents and
   score the restored text: 1 - product of (1 - precision) over its distinct marked words.

Defined results: NULL and empty texts score the floor; repeated rows are scored each; documents
with NULL labels teach nothing; without any toxic label everything scores the floor; columns other
than ids, text and labels are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import picked
from panelwright.runtime import stage

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BORDER = 26
FLOOR = 0.02
#: Bound of the labelled sample (rows with the smallest hash of their id).
SAMPLE_ROWS = 20_000
PREFIXES = range(4, 8)
SMOOTHING, BASE_RATE = 3.0, 0.1
SIGNIFICANCE = 0.01

# What signs and look-alikes can stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
    "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "aeiou",
}
LOOK_ALIKES = str.maketrans(dict(zip("аеорсхуіјѕοαειı", "aeopcxyijsoaeii", strict=True)) | {"ß": "ss"})
UNSEEN = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]+")  # accents and invisible signs
SEPARATORS = "._-~/\\'"
SUBSTITUTED, MASKED, DROPPED_SIGN, DROPPED_MASK, COLLAPSED, PAIR_COLLAPSED = 1.0, 4.0, 0.5, 6.0, 0.3, 1.5  # costs, in nats

WORD = re.compile(r"[^\W\d_]+")
AROUND = re.compile(r"^([^\w\s])\1+|([^\w\s])\2+$")  # signs repeated at an edge are decoration, not letters
TRIPLE = re.compile(r"(.)\1\1")
PAIR = re.compile(r"([a-z])\1")
SPACED = re.compile(r"(?<!\S)\S[.,_-]?(?:\s+\S[.,_-]?){2,}(?!\S)")
EDGES = ".,;:?\"'()[]{}<>…«»“”‘’`"


def folded(text: str) -> str:
    """Lower case without accents, invisible characters and look-alike letters."""
    lowered = text.lower()
    if not lowered.isascii():
        lowered = UNSEEN.sub("", unicodedata.normalize("NFKD", lowered)).translate(LOOK_ALIKES)
    return lowered


# ---- language model -------------------------------------------------------------------------


def trigram_counts(texts: DataFrame) -> np.ndarray:
    """Counts [a, b, c] of letters (26: border) over all words of the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27 * 27 * 27, np.int64)
        codes = np.full(128, BORDER, np.int64)
        codes[[ord(c) for c in LETTERS]] = np.arange(26)
        for batch in batches:
            for t in batch.column("text"):
                plain = folded(t.as_py() or "").encode("ascii", "replace")
                if not plain:
                    continue
                x = codes[np.frombuffer(plain, np.uint8)]
                x = np.concatenate([[BORDER], x, [BORDER]])
                x = x[np.concatenate([[True], (x[1:] != BORDER) | (x[:-1] != BORDER)])]  # one border between words
                before = np.concatenate([[BORDER], x[:-2]])
                before[x[:-1] == BORDER] = BORDER
                total += np.bincount((before * 27 + x[:-1]) * 27 + x[1:], minlength=27**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["gram", "n"])

    counted = texts.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(27**3, np.int64)
    out[counted["gram"].to_numpy()] = counted["n"].to_numpy()
    return out.reshape(27, 27, 27)


def language_model(counts: np.ndarray) -> list[list[list[float]]]:
    """Costs -log p(c | a, b), trigrams backed by bigrams backed by letters, in nats."""
    letters = counts.sum(axis=(0, 1)) + 1.0
    letters /= letters.sum()
    pairs = counts.sum(axis=0) + 20 * letters[None, :]
    pairs /= pairs.sum(axis=1, keepdims=True)
    threes = counts + 20 * pairs[None, :, :]
    threes /= threes.sum(axis=2, keepdims=True)
    return (-np.log(threes)).tolist()


# ---- channel --------------------------------------------------------------------------------


def lattice(token: str) -> list[list[tuple[int | None, float]]]:
    """Per character the letters it may be (None: nothing) with the channel's costs."""
    out: list[list[tuple[int | None, float]]] = []
    for k, c in enumerate(token):
        again = bool(k) and token[k - 1] == c
        stretched = again and (k > 1 and token[k - 2] == c or token[k + 1 : k + 2] == c)
        once = COLLAPSED if stretched else PAIR_COLLAPSED
        options: list[tuple[int | None, float]] = []
        if c in LETTERS:
            options.append((ord(c) - 97, 0.0))
        for letter in STANDS_FOR.get(c, ""):
            options.append((ord(letter) - 97, MASKED if len(STANDS_FOR[c]) > 2 else SUBSTITUTED))
        if c in SEPARATORS or not options:
            options.append((None, DROPPED_SIGN))
        elif again:
            options.append((None, once))
        elif len(STANDS_FOR.get(c, "")) > 2:
            options.append((None, DROPPED_MASK))
        out.append(options)
    return out


def decoded(token: str, model: list[list[list[float]]], borders: bool = False) -> str:
    """The likeliest word behind a token (Viterbi over the last two letters); with ``borders``, the likeliest words."""
    paths: dict[tuple[int, int], tuple[float, tuple]] = {(BORDER, BORDER): (0.0, ())}
    for options in lattice(token):
        following: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, word) in paths.items():
            for letter, price in options:
                if letter is None:
                    state, total, grown = (a, b), cost + price, word
                else:
                    state, total, grown = (b, letter), cost + price + model[a][b][letter], (word, LETTERS[letter])
                    if borders and b != BORDER:
                        opened = cost + price + model[a][b][BORDER] + model[BORDER][BORDER][letter]
                        if (BORDER, letter) not in following or opened < following[BORDER, letter][0]:
                            following[BORDER, letter] = (opened, ((word, " "), LETTERS[letter]))
                if state not in following or total < following[state][0]:
                    following[state] = (total, grown)
        paths = following
    return min((cost + model[a][b][BORDER], _spelt(word)) for (a, b), (cost, word) in paths.items())[1]


def _spelt(word: tuple) -> str:
    """The letters of a path, which is (path before, letter)."""
    out = []
    while word:
        word, letter = word
        out.append(letter)
    return "".join(reversed(out))


def _doubtful(token: str) -> bool:
    if token.isalpha():
        return PAIR.search(token) is not None or TRIPLE.search(token) is not None
    return any(c.isalpha() for c in token) or (
        len(token) > 2 and sum(c in STANDS_FOR for c in token) == len(token) and len(set(token)) > 2 and not token.isdigit()
    )


class Restorer:
    """Words of a text after decoding; remembers tokens, up to a bound."""

    def __init__(self, model: list[list[list[float]]]) -> None:
        self.model = model
        self.known: dict[str, tuple[str, ...]] = {}

    def _restored(self, token: str) -> tuple[str, ...]:
        bare = AROUND.sub("", token.strip(EDGES)).strip(EDGES)
        out = [bare] if bare.isalpha() else WORD.findall(bare)
        if bare and _doubtful(bare):
            out.append(decoded(bare, self.model))
            stripped = bare.rstrip("!*#$%&|+(")
            if stripped != bare and _doubtful(stripped):
                out.append(decoded(stripped, self.model))
        return tuple(dict.fromkeys(w for w in out if w))

    def spaced(self, plain: str) -> list[str]:
        """Words whose letters stand apart: a run as one word, and as the likeliest words."""
        runs = ["".join(t[0] for t in run.split()) for run in SPACED.findall(plain)]
        return list(dict.fromkeys(w for run in runs for w in [decoded(run, self.model), *decoded(run, self.model, True).split()]))

    def words(self, text: str | None) -> set[str]:
        """Distinct words, as written and as restored."""
        plain = folded(text) if text else ""
        out: set[str] = set()
        known = self.known
        for token in set(plain.split()):
            found = known.get(token)
            if found is None:
                if len(known) >= 500_000:
                    known.clear()
                found = known[token] = self._restored(token)
            out.update(found)
        out.update(self.spaced(plain))
        return out


# ---- classifier -----------------------------------------------------------------------------


def features(word: str) -> Iterator[str]:
    yield "=" + word
    for n in PREFIXES:
        if len(word) >= n:
            yield word[:n]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text`` and ``toxic`` of at most ``rows`` labelled documents that are not held out, staged.

    Copies and near copies would count a text many times, so of documents with the same label
    whose three-word shingles have the same minimum hash one is left.
    """
    marks = picked(labels, label_id="doc_id", toxic="toxic").where("toxic IS NOT NULL AND label_id IS NOT NULL")
    marks = marks.where(~held_out(F.col("label_id"))).orderBy(F.xxhash64("label_id"), "label_id", "toxic").limit(rows)
    known = docs.join(F.broadcast(marks), docs["doc_id"] == marks["label_id"]).select("text", F.col("toxic").cast("int").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = []
            for t in batch.column("text"):
                w = (t.as_py() or "").encode().lower().split()
                sketch.append(min((xxhash.xxh3_64_intdigest(b" ".join(w[k : k + 3])) for k in range(max(1, len(w) - 2))), default=0) >> 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sketch, pa.int64())], names=["text", "toxic", "sketch"])

    return stage(known.mapInArrow(run, "text string, toxic int, sketch long").dropDuplicates(["sketch", "toxic"]).drop("sketch"))


def _feature_counts(sample: DataFrame, model, wanted) -> DataFrame:
    """``f`` and ``n``: documents with each feature (of ``wanted``, if given), summed per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model.value)
        only = wanted.value if wanted else None
        counts: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column("text"):
                found = {f for word in restore.words(t.as_py()) for f in features(word)}
                counts.update(found if only is None else found & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["f", "n"])

    return sample.select("text").mapInArrow(run, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))


def learnt(sample: DataFrame, model) -> dict[str, float]:
    """Feature -> smoothed share of toxic documents among those with it, for features that mark toxicity.

    A feature counts if toxic documents have it more often than the base rate explains, after a
    correction for the number of features tried (log-likelihood ratio against the base rate).
    """
    n_rows, n_toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0))).first()
    if not n_toxic:
        return {}
    tried = stage(_feature_counts(sample.where("toxic = 1"), model, None))
    n_tried = tried.count()
    base = n_toxic / n_rows
    needed = 2 * math.log(max(n_tried, 1) / SIGNIFICANCE)
    if base == 1:
        return {}
    least = math.ceil(needed / (-2 * math.log(base)) - 1e-9)  # toxic documents that a feature needs even if no other has it
    frequent = [(r["f"], r["n"]) for r in tried.where(F.col("n") >= max(least, 3)).orderBy("f").collect()]  # of the sample's documents
    wanted = sample.sparkSession.sparkContext.broadcast({f for f, _ in frequent})
    clean = {r["f"]: r["n"] for r in _feature_counts(sample.where("toxic != 1"), model, wanted).collect()}
    out = {}
    for f, t in frequent:
        n = t + clean.get(f, 0)
        p = t / n
        if p < 0.5 or p <= base:
            continue
        ratio = 2 * (t * math.log(p / base) + ((n - t) * math.log((1 - p) / (1 - base)) if n > t else 0.0))
        if ratio >= needed:
            out[f] = (t + SMOOTHING * BASE_RATE) / (n + SMOOTHING)
    return out


class Scorer(Restorer):
    """Scores texts; remembers which words of a token are marked, mostly none."""

    def __init__(self, model: list[list[list[float]]], weights: dict[str, float]) -> None:
        super().__init__(model)
        self.weights = weights
        self.starts = {f.lstrip("=")[:4] for f in weights}
        self.marks: dict[str, dict[str, float]] = {}

    def _marked(self, words: tuple[str, ...]) -> dict[str, float]:
        best = {w: max((self.weights.get(f, 0.0) for f in features(w)), default=0.0) for w in words if w[:4] in self.starts}
        return {w: p for w, p in best.items() if p}

    def _marks_of(self, token: str) -> dict[str, float]:
        bare = token.strip(EDGES)
        if bare.isalpha() and bare[:4] not in self.starts and not _doubtful(bare):
            return {}  # most tokens
        return self._marked(self._restored(token))

    def score(self, text: str | None) -> float:
        plain = folded(text) if text else ""
        found: dict[str, float] = {}
        marks = self.marks
        for token in set(plain.split()):
            marked = marks.get(token)
            if marked is None:
                if len(marks) >= 500_000:
                    marks.clear()
                marked = marks[token] = self._marks_of(token)
            if marked:
                found.update(marked)
        for word in self.spaced(plain):
            found.update(self._marked((word,)))
        clear = 1.0
        for word in sorted(found):
            clear *= 1 - found[word]
        return FLOOR + (1 - FLOOR) * (1 - clear)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per document ``doc_id``, ``held_out``, ``score``, ``predicted``."""
    spark = docs.sparkSession
    rows = picked(docs, doc_id="doc_id", text="text")
    model = spark.sparkContext.broadcast(language_model(trigram_counts(rows)))
    weights = spark.sparkContext.broadcast(learnt(training_sample(rows, labels), model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value, weights.value)
        for batch in batches:
            found = [scorer.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def restored(docs: DataFrame, model) -> DataFrame:
    """``doc_id`` and ``words``: the distinct words that decoding adds to those written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model.value)
        for batch in batches:
            found = []
            for t in batch.column("text"):
                plain = set(WORD.findall(folded(t.as_py() or "")))
                found.append(sorted(restore.words(t.as_py()) - plain))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, words array<string>")
