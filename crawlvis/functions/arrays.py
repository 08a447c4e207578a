"""Running values over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlvis.functions.fence import let


def running(x: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array of whole numbers, all values up to it merged by an associative ``merge``.

    In blocks of the root of the length: an array that grows by one value is copied, so one block for all would take quadratic time.
    """
    none = F.array().cast("array<long>")

    def plain(values: Column) -> Column:
        last = lambda a: F.get(a, F.size(a) - 1)
        return F.aggregate(values, none, lambda a, v: F.concat(a, F.array(F.when(F.size(a) == 0, v).otherwise(merge(last(a), v)))))

    def joined(parts: Column) -> Column:
        ends = plain(F.transform(parts, lambda p: F.element_at(p, -1)))
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(F.transform(p, lambda v: merge(F.get(e, k - 1), v))))))

    def whole(values: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(values))).cast("int")
        return let(F.transform(F.sequence(F.lit(1), F.size(values), width), lambda i: plain(F.slice(values, i, width))), joined)

    return let(F.transform(x, lambda v: v.cast("long")), lambda values: F.when(F.size(values) > 0, whole(values)).otherwise(none))


def running_sums(x: Column) -> Column:
    return running(x, lambda a, b: a + b)


def running_least(x: Column) -> Column:
    return running(x, lambda a, b: F.least(a, b))
