"""Columns from fixed texts with values put in."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(text: str, **values: Column) -> Column:
    """``text`` with each ``{name}`` replaced by the column of that name, as a string. A null value gives null."""
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*[(values[p].cast("string") if i % 2 else F.lit(p)) for i, p in enumerate(parts) if i % 2 or p])


def looked_up(table: dict, key: Column, default: Column | None = None) -> Column:
    """The value of ``key`` in a small fixed table."""
    found = F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    return found if default is None else F.coalesce(found, default)


def chosen(table: dict[str, Column], key: Column) -> Column:
    """The column that ``table`` has for the key."""
    out = None
    for name, column in table.items():
        out = F.when(key == name, column) if out is None else out.when(key == name, column)
    return out
