"""Shared by the tests of this folder; a module of its own, as every folder of tests has a ``conftest``."""

from __future__ import annotations


def rows(df, *columns):
    """Sorted tuples of a result."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=lambda r: [(v is not None, str(type(v)), v if v is not None else 0) for v in r])
