"""Column helpers for operators that stay in DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words, as a pattern and as characters.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def own_columns(columns: list[str]) -> list[Column]:
    """All columns by quoted name, so that dots in names are harmless."""
    return [F.col(f"`{c}`") for c in columns]
