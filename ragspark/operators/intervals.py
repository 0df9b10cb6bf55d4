"""Overlap joins of intervals within a key, such as offsets within a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of a bucket of offsets.
BUCKET = 1 << 14


def overlapping(left: DataFrame, right: DataFrame, on: tuple[str, str], left_bounds: tuple[str, str], right_bounds: tuple[str, str], bucket: int = BUCKET) -> DataFrame:
    """left with right where both have the same key (on: a column of each side) and their intervals [start, end) overlap.

    Each interval is dealt to the buckets of offsets that it reaches into, and key and bucket are the join's key: one document with very
    many intervals is as many tasks as it has buckets, and an interval meets only what lies near it. A pair that shares several
    buckets is given in the first of them. Columns of the two sides must not share names."""
    first = lambda bounds: F.floor(F.col(bounds[0]) / bucket)
    last = lambda bounds: F.greatest(first(bounds), F.floor((F.col(bounds[1]) - 1) / bucket))
    dealt = lambda rows, bounds, name: rows.withColumn(name, F.explode(F.sequence(first(bounds), last(bounds))))
    a, b = dealt(left, left_bounds, "_left_bucket"), dealt(right, right_bounds, "_right_bucket")
    met: Column = (F.col(on[0]) == F.col(on[1])) & (F.col("_left_bucket") == F.col("_right_bucket"))
    met &= (F.col(left_bounds[0]) < F.col(right_bounds[1])) & (F.col(left_bounds[1]) > F.col(right_bounds[0]))
    met &= F.col("_left_bucket") == F.greatest(first(left_bounds), first(right_bounds))
    return a.join(b, met).drop("_left_bucket", "_right_bucket")
