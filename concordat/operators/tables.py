"""Keyed tables kept as Parquet: latest-wins upserts that rewrite only what changed.

Rows live in hash buckets of the key (a partition column). An upsert or delete
reads and replaces just the buckets its keys fall in, in one dynamic partition
overwrite. A few keys touch a few buckets; an update of more keys than buckets
rewrites the table, so choose ``buckets`` with the size of the table (about one
for each gigabyte). Updates are written once to the shared checkpoint folder and
read from there: whatever made them runs once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.operators.evaluate import keep_last
from concordat.session import ensure_checkpoint_dir

BUCKET = "key_bucket"


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def merge_latest(current: DataFrame, updates: DataFrame, key: str, order: str, *,
                 only: list[str] | None = None) -> DataFrame:
    """Current rows with updates applied; the latest update per key wins.

    ``only`` lists the columns an update may change on an existing row; new
    keys are always taken whole.
    """
    latest = keep_last(updates, key, order)
    columns = current.columns
    if only is None:
        kept = current.join(latest.select(key), key, "left_anti")
        return kept.select(columns).unionByName(latest.select(columns))
    changed = latest.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in columns if c != key],
                            F.lit(True).alias("_hit"))
    known = current.withColumn("_known", F.lit(True)).join(changed, key, "full_outer")
    pick = [F.col(key) if c == key else
            F.when(F.col("_known").isNull() | (F.lit(c in only) & F.col("_hit")), F.col(f"_new_{c}")).otherwise(
                F.col(c)).alias(c) for c in columns]
    return known.select(*pick)


def create_if_absent(spark: SparkSession, path: str, schema: str, *, recreate: bool = False) -> None:
    """Create an empty table folder; keep an existing one unless ``recreate``."""
    if exists(spark, path) and not recreate:
        return
    empty = spark.createDataFrame([], f"{schema}, {BUCKET} int")
    empty.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema(f"{BUCKET} int").parquet(path).limit(0).count()
    except AnalysisException:
        return False
    return True


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the table. Every written bucket holds one row without values, so that it can be emptied in the same
    commit that fills others; it is left out here."""
    rows = spark.read.schema(f"{schema}, {BUCKET} int").parquet(path).drop(BUCKET)
    return rows.filter(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in rows.columns]))


def once(df: DataFrame) -> DataFrame:
    """The frame, evaluated now and only now."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _rewrite(spark: SparkSession, path: str, schema: str, keys: DataFrame, key: str, buckets: int, change) -> None:
    touched = [r[0] for r in keys.select(bucket_of(key, buckets)).distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    inside = bucket_of(key, buckets).isin(touched)
    current = spark.read.schema(f"{schema}, {BUCKET} int").parquet(path).filter(F.col(BUCKET).isin(touched) & F.col(key).isNotNull())
    result = change(current.drop(BUCKET)).withColumn(BUCKET, bucket_of(key, buckets)).filter(inside)
    empty = spark.createDataFrame([(b,) for b in touched], f"{BUCKET} int")
    # Write tasks by bytes: large buckets are split, small ones share a task.
    result.unionByName(empty, allowMissingColumns=True).hint("rebalance", BUCKET).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def upsert(spark: SparkSession, path: str, schema: str, updates: DataFrame, key: str, order: str, *,
           only: list[str] | None = None, buckets: int = 64) -> None:
    updates = once(updates.filter(F.col(key).isNotNull()))
    _rewrite(spark, path, schema, updates, key, buckets,
             lambda current: merge_latest(current, updates, key, order, only=only))


def delete(spark: SparkSession, path: str, schema: str, keys: DataFrame, key: str, *, buckets: int = 64,
           match: str | None = None) -> int:
    """Remove rows; returns how many. ``match`` names the column of ``path``
    compared with ``keys`` when it is not the table's own key - then every
    bucket is read."""
    column = match or key
    wanted = keys.select(F.col(keys.columns[0]).alias(column)).distinct()
    current = read_table(spark, path, schema)
    doomed = once(current.join(wanted, column, "left_semi"))
    removed = doomed.count()
    if removed:
        _rewrite(spark, path, schema, doomed.select(key), key, buckets,
                 lambda rows: rows.join(wanted, column, "left_anti"))
    return removed
