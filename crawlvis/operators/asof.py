"""The last value before each row of a key, without sorting a key's rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Time, in the unit of the rows' clock, that one task sorts of a key.
BUCKET_MS = 86_400_000


def last_before(rows: DataFrame, key: str, clock: Column, order: tuple[str, ...], value: Column, name: str) -> DataFrame:
    """``rows`` with the column ``name``: the last ``value`` that isn't null among the key's rows before, in ``order``.

    Rows are dealt by key and bucket of ``clock``, in milliseconds, which must not fall in ``order``. What the buckets before
    leave is told by one row for each bucket of a key. Ties of ``order`` are in any order; a null clock is a bucket of its own,
    before all others.
    """
    placed = rows.withColumns({"_bucket": F.coalesce(F.floor(clock / BUCKET_MS), F.lit(-(2**62))), "_value": value})
    inside = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    known = placed.where("_value IS NOT NULL").groupBy(key, "_bucket").agg(F.max_by("_value", F.struct(*order)).alias("_end"))
    buckets = placed.select(key, "_bucket").distinct().alias("b").join(known.alias("k"), F.col(f"b.{key}").eqNullSafe(F.col(f"k.{key}")) & (F.col("b._bucket") == F.col("k._bucket")), "left").select(f"b.{key}", "b._bucket", "k._end")
    carried = buckets.select(key, "_bucket", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    own = placed.withColumn("_own", F.last("_value", ignorenulls=True).over(inside))
    joined = own.alias("l").join(carried.alias("c"), F.col(f"l.{key}").eqNullSafe(F.col(f"c.{key}")) & (F.col("l._bucket") == F.col("c._bucket")))
    return joined.select(*[F.col(f"l.`{c}`") for c in rows.columns], F.coalesce("l._own", "c._carried").alias(name))
