"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

from importlib import import_module

from panelwright.catalog.book import BOOK, Book

SECTIONS = ("commerce", "basics", "forecast", "econometrics", "text")


def load() -> Book:
    for section in SECTIONS:
        import_module(f"panelwright.catalog.{section}")
    return BOOK
