"""Ranks and running sums within keys, however many rows a key has.

Rows lie in slices (a column): sums per (key, slice) are small, and a running
sum over them gives each slice its offset; only rows of one slice are ever
sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_rank(df: DataFrame, keys: list[str], slice_col: str, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the row's number, from 0, among the rows of its keys, by slice and then ``order``."""
    return with_running(df.withColumn("_one", F.lit(1)), keys, slice_col, order, "_one", name).drop("_one")


def with_running(df: DataFrame, keys: list[str], slice_col: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows before this one in its keys, by slice and then ``order``.

    ``df`` must be fixed (pinned, or slices by a hash of the row); keys and slice must not be null.
    """
    at = [*keys, slice_col]
    inside = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*at).agg(F.sum(value).alias("_s"))
    offsets = sums.select(*at, F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    local = df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(offsets, at).withColumn(name, F.col("_before") + F.col("_in")).drop("_before", "_in")
