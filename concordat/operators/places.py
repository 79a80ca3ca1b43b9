"""Rows by their place in the files: ordinals that no layout changes, and joins on them.

A table read back by tasks has no row numbers; sorting or numbering rows at
query time depends on how they were split. The place of a row - its file, and
its number in that file - is written in the file itself, so a retried task, other
splits or another cluster give the same one. Ordinals over several files
add the number of rows in the files before, in order of their names: one row for
each file, never a sort of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordat.session import broadcast_if_small

PLACE = "_place"


def file_offsets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, before): the number of rows in the files that come earlier, by name. One row for each file."""
    rows = spark.read.parquet(*([path] if isinstance(path, str) else path)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    number = rows.groupBy("file").agg((F.max("row") + 1).alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return number.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def scan(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, place: str = PLACE) -> DataFrame:
    """Parquet files with the ordinal ``place`` (from 0) of every row over all files.

    Filters and projections after it keep the ordinals of the whole table, as an
    index does; only the columns asked for are read.
    """
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    columns = columns or df.columns
    if place in df.columns:
        raise ValueError(f"{place} is a column of {path}")
    placed = df.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    offsets = broadcast_if_small(file_offsets(spark, path).withColumnRenamed("file", "_file"))
    return placed.join(offsets, "_file").select(*columns, (F.col("before") + F.col("_row")).alias(place))


def reattach(part: DataFrame, whole: DataFrame, columns: list[str], place: str = PLACE) -> DataFrame:
    """``part`` with ``columns`` of the rows of ``whole`` that have the same place.

    Every row of ``part`` stays, once, as ``whole`` has a place only once; a column that it has already is
    replaced, and a place ``whole`` does not have gives NULL.
    """
    found = whole.select(F.col(place).alias("_at"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    kept = [c for c in part.columns if c not in columns]
    joined = part.join(found, F.col(place) == F.col("_at"), "left")
    return joined.select(*kept, *[F.col(f"_new_{c}").alias(c) for c in columns])


def side_by_side(left: DataFrame, right: DataFrame, place: str = PLACE) -> DataFrame:
    """Two tables row by row: the first row beside the first, and so on; the longer one goes on beside NULL."""
    clash = sorted((set(left.columns) & set(right.columns)) - {place})
    if clash:
        raise ValueError(f"both sides have the columns {clash}")
    return left.join(right, place, "full_outer")
