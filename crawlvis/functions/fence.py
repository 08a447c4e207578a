"""A fence for expensive columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fenced(df: DataFrame, columns: dict[str, Column] | None = None, *, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with new columns that are computed once a row, whatever refers to them.

    The optimizer merges neighbouring projections and would copy a column's expression into each use; it doesn't
    look through a generator, and this one makes one row of one row.
    """
    columns = columns or {}
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns and c not in drop]
    return df.select(F.inline(F.array(F.struct(*kept, *[c.alias(n) for n, c in columns.items()]))))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often the result refers to it."""
    return F.element_at(F.transform(F.array(value), then), 1)
