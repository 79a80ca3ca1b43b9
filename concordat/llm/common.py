"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401 - makes pa.compute available in the workers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from concordat.session import ensure_checkpoint_dir

#: Text bytes that a Python task looks at together; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19

#: Whether shuffle files are removed as soon as their query ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pinned(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there.

    Results that a lost executor must not change (row order, task numbers,
    trained scores) and costly Python passes are cut here. The shuffle files
    that led to them are removed at once, not when the driver collects garbage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # a frame keeps the setting that it was made under
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the Arrow batches with about ``limit`` text bytes each, and their texts as UTF-8 (null: empty)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield _texts(batch.slice(start, i - start), column)
                start, held = i, 0
            held += int(size)
        yield _texts(batch.slice(start), column)


def _texts(part: pa.RecordBatch, column: str) -> tuple[pa.RecordBatch, list[bytes]]:
    return part, [x or b"" for x in part.column(column).cast(pa.binary()).to_pylist()]


def map_texts(df: DataFrame, schema: str, work: Callable[[list[bytes]], dict[str, object]], *,
              keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``df`` (which has ``text``) and the columns that ``work`` makes of each block of texts."""
    out = df.select(*keep).schema
    for field in StructType.fromDDL(schema).fields:
        out = out.add(field)
    names = [f.name for f in out][len(keep):]

    def run(batches):
        for part, texts in blocks(batches):
            made = work(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(k) for k in keep] + [made[n] if isinstance(made[n], pa.Array) else pa.array(made[n])
                                                  for n in names], names=[*keep, *names])

    return df.select(*keep, "text").mapInArrow(run, out)


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """At most ``bound`` rows, those with the smallest hash of ``key``: the same rows in every run."""
    return df.orderBy(F.xxhash64(F.lit(17), key), key).limit(bound)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
