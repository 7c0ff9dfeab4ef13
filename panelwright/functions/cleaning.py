"""Scalar cleaning rules as column expressions. Bad input becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Account pattern and the three published date spellings.
ACCOUNT_PATTERN = r"\AA[0-9]{8}\z"
DATE_SPELLINGS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM-dd-yyyy")


def pick(values: list, index: Column) -> Column:
    """The ``index``-th value (from 0) of a fixed list."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def half_up(col: Column, digits: int) -> Column:
    """Rounding by ``floor(x * 10^d + 0.5) / 10^d``: the same IEEE steps in any engine."""
    scale = 10**digits
    return F.floor(col * F.lit(float(scale)) + F.lit(0.5)).cast("double") / F.lit(float(scale))


def norm_firm_id(col: Column) -> Column:
    """Keep the digits of an identifier and print them as ``F0042``; NULL without digits."""
    digits = F.nullif(F.regexp_replace(col, "[^0-9]", ""), F.lit(""))
    number = digits.try_cast("bigint")
    return F.when(number.isNotNull(), F.format_string("F%04d", number))


def quarter_label(date: Column) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))


def norm_quarter(col: Column) -> Column:
    """``2024Q1``, ``2024-Q1`` or a date to ``2024Q1``."""
    text = F.upper(F.trim(col))
    parts = r"\A([0-9]{4})-?Q([1-4])\z"
    spelled = F.when(
        text.rlike(parts),
        F.concat(F.regexp_extract(text, parts, 1), F.lit("Q"), F.regexp_extract(text, parts, 2)),
    )
    date = text.try_cast("date")
    return F.coalesce(spelled, F.when(date.isNotNull(), quarter_label(date)))


def quarter_end(label: Column) -> Column:
    """Last day of a ``2024Q1`` label."""
    year = F.substring(label, 1, 4).cast("int")
    month = F.substring(label, 6, 1).cast("int") * 3
    return F.last_day(F.make_date(year, month, F.lit(1)))


def parse_money(col: Column) -> Column:
    """``$1,234.50`` to 1234.5."""
    return F.regexp_replace(col, "[$,]", "").try_cast("double")


def norm_label(col: Column) -> Column:
    return F.initcap(F.trim(col))


def parse_date(col: Column) -> Column:
    return col.try_cast("date")


def parse_date_multi(col: Column) -> Column:
    """Date in any of the three spellings; the separators tell day-first from month-first."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(col), F.lit(f)) for f in DATE_SPELLINGS]).cast("date")


def valid_account(col: Column) -> Column:
    """Whole-string match, so a trailing newline is refused; NULL counts as invalid."""
    return F.coalesce(col.rlike(ACCOUNT_PATTERN), F.lit(False))


def signed_amount(amount: Column, is_reversal: Column) -> Column:
    return F.when(is_reversal == 1, -amount).otherwise(amount)


def bucket(col: Column, edges: list[tuple[float, str]], rest: str) -> Column:
    """Label of the first edge that is not below the value; ``rest`` above all edges."""
    out = F
    for edge, label in edges:
        out = out.when(col <= edge, label)
    return out.otherwise(rest)


def month_key(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_index(date: Column) -> Column:
    """Consecutive integer per calendar month, for range frames and equi-joins."""
    return F.year(date) * 12 + F.month(date) - 1


def month_from_index(index: Column) -> Column:
    return F.make_date(F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"), F.lit(1))


def month_start(date: Column) -> Column:
    return F.trunc(date, "MM")


def month_end(date: Column) -> Column:
    return F.last_day(date)


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def json_field(col: Column, path: str) -> Column:
    return F.get_json_object(col, path)


def safe_log(col: Column) -> Column:
    """Natural logarithm, NULL for values that have none."""
    return F.when(col > 0, F.ln(col))


def normalize_text(col: Column) -> Column:
    """Lower case, one blank between words, no blanks at the ends (Unicode white space)."""
    return F.trim(F.regexp_replace(F.lower(col), r"(?U)\s+", " "))
