"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under internal names, so that further columns can not clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def word_array(text: Column) -> Column:
    """Words between ASCII white space; NULL and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def crc32_text(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?`` or ``#``, in lower case; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, "(?s)://(.*)", 1)).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, "(?s)://(.*)", 1)).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    """The query with its ``?``, without the fragment; empty where there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*(\?[^#]*)", 1)
