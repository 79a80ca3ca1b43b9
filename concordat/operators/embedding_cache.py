"""Embedding cache: which chunks still need a vector, and filling the gaps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.text import as_col
from concordat.operators.evaluate import keep_last

CACHE_SCHEMA = "chunk_id string, text_hash string, model string, dimensions int, embedding array<float>"


def text_hash(value: Column | str) -> Column:
    return F.sha2(as_col(value), 256)


def cache_lookup(chunks: DataFrame, cache: DataFrame, *, model: str, dimensions: int | None,
                 order: str | None = None) -> DataFrame:
    """Chunks with ``hit`` and the cached ``embedding``.

    A hit needs the same chunk id, text hash, model and dimensions. With
    ``dimensions=None`` (full size) any stored size is accepted. ``order``
    names the cache's line order: the last entry per chunk counts.
    """
    latest = keep_last(cache, "chunk_id", order) if order else cache
    usable = latest.filter(F.col("model") == model)
    if dimensions is not None:
        usable = usable.filter(F.col("dimensions") == dimensions)
    slim = usable.select("chunk_id", F.col("text_hash").alias("_hash"), "embedding")
    joined = chunks.withColumn("text_hash", text_hash("text")).join(slim, "chunk_id", "left")
    hit = F.coalesce(F.col("_hash") == F.col("text_hash"), F.lit(False))
    return joined.withColumns({"hit": hit, "embedding": F.when(hit, F.col("embedding"))}).drop("_hash")


def embed_missing(looked_up: DataFrame, encode: Callable[[list[str]], list[list[float]]], *, model: str,
                  batch_size: int = 100) -> DataFrame:
    """Cache rows for the misses, encoded in batches inside the tasks."""
    misses = looked_up.filter(~F.col("hit")).select("chunk_id", "text_hash", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                vectors = encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([
                    part.column("chunk_id"), part.column("text_hash"), pa.array([model] * len(vectors), pa.string()),
                    pa.array([len(v) for v in vectors], pa.int32()), pa.array(vectors, pa.list_(pa.float32()))],
                    names=["chunk_id", "text_hash", "model", "dimensions", "embedding"])

    return misses.mapInArrow(run, CACHE_SCHEMA)


def merged_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cache after a run: fresh rows replace the old ones of the same chunk."""
    return cache.join(fresh.select("chunk_id"), "chunk_id", "left_anti").unionByName(fresh)
