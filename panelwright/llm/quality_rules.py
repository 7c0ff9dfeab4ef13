"""Quality rules as a ledger of failure bits: measure once, decide later.

``ledger`` evaluates every rule once per document and stores its measurements and one bit per
failed rule. ``verdicts`` applies a versioned policy (a mask of rules) to stored bits, and
``ablation`` shows what each rule of each policy decides alone, without touching a text again.
Everything is a DataFrame expression within the document's row: no shuffle, no Python.

Defined results: a NULL or empty text has no words and fails ``few_words``; repeated rows and
NULL ids are measured row by row; an empty table gives an empty ledger; columns other than the
id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import picked, word_array

WINDOW = 8
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _c(name: str) -> Column:
    return F.col(name)


#: The position is the bit; append only.
RULES = ("few_words", "repeated_words", "many_symbols", "short_words", "long_words", "duplicate_lines", "shouting", "exclaiming")


def conditions() -> dict[str, Column]:
    """Rule -> condition of failure over the measurements."""
    n = _c("n_words")
    return {
        "few_words": n < 20,
        "repeated_words": 100 * _c("n_repeat_words") > 30 * n,
        "many_symbols": 100 * _c("n_symbols") > 10 * n,
        "short_words": _c("word_chars") < 3 * n,
        "long_words": _c("word_chars") > 12 * n,
        "duplicate_lines": 2 * _c("n_dup_lines") > _c("n_lines"),
        "shouting": 100 * _c("n_upper") > 40 * _c("word_chars"),
        "exclaiming": 2 * _c("n_exclaims") > n,
    }


def mask(*names: str) -> int:
    return sum(1 << RULES.index(n) for n in names)


BASE = mask("few_words", "repeated_words")
#: Policy version -> mask of the rules that reject. Versions are never edited, only added.
POLICIES = {"base": BASE, "2": mask(*RULES)}
PRODUCTION = "2"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims")


def _removed(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _repeated(sorted_pairs: str) -> Column:
    """Of sorted (value, position) structs those whose value stands next to an equal one."""
    pairs = F.col(sorted_pairs)

    def twin(x: Column, k: Column) -> Column:
        before = (k > 0) & (F.get(pairs, k - 1)["v"] == x["v"])
        after = (k + 1 < F.size(pairs)) & (F.get(pairs, k + 1)["v"] == x["v"])
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    return F.filter(pairs, twin)


def _paired(array: str, apart: int) -> Column:
    """Hash of every element with the one ``apart`` places on: doubles the length that a hash stands for."""
    return F.transform(F.col(array), lambda h, i: F.xxhash64(h, F.get(F.col(array), i + apart)))


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Adds the measurements to the columns ``keep`` of a frame with a column ``text``.

    Repeated windows are found by hash (of 2, 4 and then 8 words) and confirmed as text, both
    sorted within the row, so a text of n words costs n log n.
    """
    kept = [F.col(k) for k in keep]
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(" \t\x0b\f\r")) != "")
    step = docs.select(
        *kept,
        word_array(F.col("text")).alias("_words"),
        lines.alias("_lines"),
        F.regexp_replace(text, f"[^{UPPER[0]}-{UPPER[-1]}!{SYMBOLS}]+", "").alias("_marks"),
    )
    step = step.select(
        *kept,
        "_words",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _removed(F.col("_marks"), SYMBOLS).alias("n_symbols"),
        _removed(F.col("_marks"), UPPER).alias("n_upper"),
        _removed(F.col("_marks"), "!").alias("n_exclaims"),
        _paired("_words", 1).alias("_pairs"),
    )
    done = ["word_chars", "n_lines", "n_dup_lines", "n_symbols", "n_upper", "n_exclaims"]
    step = step.select(*kept, *done, "_words", _paired("_pairs", 2).alias("_fours"))
    step = step.select(
        *kept,
        *done,
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.slice(_paired("_fours", 4), 1, F.greatest(F.size("_fours") - (WINDOW - 1), F.lit(0))).alias("_hashes"),
    )
    done.append("n_words")
    nothing = F.array().cast("array<struct<v:bigint,i:int>>")
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    step = step.select(*kept, *done, F.when(repeats, F.col("_words")).alias("_words"), F.when(repeats, F.col("_hashes")).alias("_hashes"))
    step = step.select(
        *kept,
        *done,
        "_words",
        F.when(
            F.col("_hashes").isNotNull(),
            F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("v"), (i + 1).alias("i")))),
        )
        .otherwise(nothing)
        .alias("_by_hash"),
    )
    step = step.select(
        *kept,
        *done,
        F.sort_array(
            F.transform(
                _repeated("_by_hash"),
                lambda x: F.struct(F.array_join(F.slice("_words", x["i"], WINDOW), " ").alias("v"), x["i"].alias("i")),
            )
        ).alias("_by_text"),
    )
    step = step.select(*kept, *done, F.sort_array(F.transform(_repeated("_by_text"), lambda x: x["i"])).alias("_at"))
    gaps = F.zip_with(
        F.col("_at"),
        F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))),
        lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))),
    )
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)
    # The row id, always true here, keeps a later filter above these steps. Pushed below them it would take all
    # their expressions along, one inside the other, and compute them for every element of the arrays.
    return step.select(*kept, *done, F.when(F.monotonically_increasing_id() >= 0, covered).alias("n_repeat_words"))


def failure_bits() -> Column:
    failed = conditions()
    out = F.lit(0).cast("long")
    for bit, name in enumerate(RULES):
        out = out.bitwiseOR(F.when(failed[name], F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """Per document its id, ``extra`` columns, measurements and ``fail_bits``."""
    rows = picked(docs, doc_id=id_column, text=text_column, **{e: e for e in extra})
    return measured(rows, ["doc_id", *extra]).select("doc_id", *extra, *MEASURES, failure_bits().alias("fail_bits"))


def rejected(bits: Column, policy: str) -> Column:
    return bits.bitwiseAND(F.lit(POLICIES[policy]).cast("long")) != 0


def verdicts(entries: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """A ledger with ``base_failed``, ``kept`` and the policy's version."""
    return entries.withColumns(
        {
            "base_failed": rejected(F.col("fail_bits"), "base"),
            "kept": ~rejected(F.col("fail_bits"), "base") & ~rejected(F.col("fail_bits"), policy),
            "policy": F.lit(policy),
        }
    )


def ablation(entries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per policy and rule: documents that fail it, that only it rejects, and kept with and without it.

    Documents are first counted by their bits (at most 2 to the number of rules, per group), so
    the second step works on patterns only. ``seen_bits`` and ``common_bits`` are the OR and the
    AND of the bits of all documents that the policy rejects.
    """
    by = by or []
    patterns = entries.groupBy(*by, "fail_bits").agg(F.count(F.lit(1)).alias("n"))
    policies = F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(m).cast("long").alias("mask")) for v, m in POLICIES.items()])
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << b).cast("long").alias("bit")) for b, r in enumerate(RULES)])
    rows = patterns.select(*by, "fail_bits", "n", F.explode(policies).alias("p"))
    rows = rows.select(*by, "n", "p.*", F.col("fail_bits").bitwiseAND(F.col("p.mask")).alias("hit"), F.explode(rules).alias("r"))
    rows = rows.select(*by, "n", "policy", "mask", "hit", "r.*").where(F.col("mask").bitwiseAND(F.col("bit")) != 0)

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return rows.groupBy(*by, "policy", "rule").agg(
        F.sum("n").alias("n_docs"),
        total(F.col("hit").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("hit") == F.col("bit")).alias("n_only"),
        total(F.col("hit") == 0).alias("n_kept"),
        total(F.col("hit").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
        F.expr("bit_or(hit)").alias("seen_bits"),
        F.expr("bit_and(hit) FILTER (WHERE hit != 0)").alias("common_bits"),
    )


def keep_good(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The documents that the policy keeps, with all their columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    entries = measured(docs.select(row.alias("_row"), F.col("text")), ["_row"])
    good = entries.where(~rejected(failure_bits(), "base") & ~rejected(failure_bits(), policy))
    return good.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
