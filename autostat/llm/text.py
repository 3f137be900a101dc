"""Words, lines and helpers for expressions on arrays, all as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, also where `body` uses it inside another lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole(text: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Runs of characters other than space and \\t..\\r, in order."""
    return F.array_remove(F.split(text, WORD_BREAK), "")


def total(values: Column, kind: str = "long") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x)
