"""Filtered vector search over chunk rows, and the vector table itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.operators import tables


def point_id(chunk_id: Column | str) -> Column:
    """Unsigned 64-bit id: the first eight bytes of the MD5 digest, big-endian."""
    c = F.col(chunk_id) if isinstance(chunk_id, str) else chunk_id
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 16), 16, 10).cast("decimal(20,0)")


DISTANCES = ("cosine", "dot", "euclid")


def similarities(vector: Column | str, query: list[float], distances: tuple[str, ...] = DISTANCES) -> Column:
    """Struct of every row's similarities to one query, in one pass over the Arrow batches.

    A batch's vectors are one contiguous buffer, so this is one matrix-vector
    product per batch instead of interpreted lambdas per component. ``euclid``
    is the negated distance, so that larger is nearer in all cases. Vectors of
    another length, and zero vectors for the cosine, give NULL.
    """
    if unknown := set(distances) - set(DISTANCES):
        raise ValueError(f"unknown distance {sorted(unknown)}")
    q = np.asarray(query, dtype=np.float64)

    @F.arrow_udf(T.StructType([T.StructField(d, T.DoubleType()) for d in distances]))
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            valid = np.asarray(batch.is_valid()) & (np.asarray(batch.value_lengths().fill_null(0)) == len(q))
            rows = batch.filter(pa.array(valid))
            matrix = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), len(q))
            dots, found = matrix @ q, {}
            if "dot" in distances:
                found["dot"] = dots
            if "cosine" in distances:
                norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix)) * np.sqrt(q @ q)
                found["cosine"] = np.divide(dots, norms, out=np.full(len(rows), np.nan), where=norms > 0)
            if "euclid" in distances:
                found["euclid"] = -np.sqrt(((matrix - q) ** 2).sum(axis=1))
            out = []
            for d in distances:
                column = np.full(len(batch), np.nan)
                column[valid] = found[d]
                out.append(pa.array(column, from_pandas=True))
            yield pa.StructArray.from_arrays(out, names=list(distances))

    return score(F.col(vector) if isinstance(vector, str) else vector)


def similarity(vector: Column | str, query: list[float], distance: str = "cosine") -> Column:
    """One similarity of every row's vector to one query."""
    return similarities(vector, query, (distance,))[distance]


def metadata_filter(*, exclude_references: bool = True, doi: str | None = None,
                    years: tuple[int, int] | None = None, section_types: list[str] | None = None,
                    author_orcid: str | None = None) -> Column:
    """Conjunction of the search filters; plain predicates, so they reach the scan."""
    keep = F.lit(True)
    if exclude_references:
        keep = keep & (F.col("is_references") == F.lit(False))
    if doi:
        keep = keep & (F.col("doi") == doi)
    if years:
        keep = keep & F.col("publication_year").between(*years)
    if section_types:
        keep = keep & F.col("section_type").isin(*section_types)
    if author_orcid:
        keep = keep & F.array_contains("author_orcids", author_orcid)
    return keep


def search(vectors: DataFrame, query: list[float], *, vector: str = "embedding", id_column: str = "id",
           limit: int = 10, where: Column | None = None, distance: str = "cosine") -> DataFrame:
    """Top ``limit`` rows by similarity; ties go to the smaller id.

    Only the id and the vector are scored. ``orderBy.limit`` runs as
    TakeOrderedAndProject: each task keeps ``limit`` rows, nothing is shuffled.
    """
    rows = vectors.filter(where) if where is not None else vectors
    # The lengths are checked on the column itself: a filter on the score would be pushed below the
    # projection and score every vector again. Vectors without a direction sort last, and go afterwards.
    fit = rows.filter(F.col(vector).isNotNull() & (F.size(vector) == len(query)))
    best = fit.withColumn("score", similarity(vector, query, distance)).drop(vector).orderBy(
        F.desc_nulls_last("score"), id_column).limit(limit)
    return best.filter(F.col("score").isNotNull())


def scroll(rows: DataFrame, *, limit: int | None = None, section_type: str | None = None, title_contains: str | None = None,
           flag: str | None = None) -> DataFrame:
    """Metadata-only listing, no vector involved."""
    if section_type is not None:
        rows = rows.filter(F.col("section_type") == section_type)
    if title_contains is not None:
        rows = rows.filter(F.lower("section_title").contains(title_contains.lower()))
    if flag is not None:
        rows = rows.filter(F.col(flag))
    return rows if limit is None else rows.limit(limit)


def collection_stats(vectors: DataFrame, name: str, vector: str = "embedding") -> DataFrame:
    return vectors.agg(F.lit(name).alias("collection_name"), F.count(F.lit(1)).alias("points_count"),
                       F.count(vector).alias("vectors_count"), F.min(F.size(vector)).alias("min_dimensions"),
                       F.max(F.size(vector)).alias("max_dimensions")).withColumn(
        "status", F.when(F.col("points_count") == F.col("vectors_count"), "green").otherwise("yellow"))


class VectorTable:
    """Vector rows as a bucketed keyed table on shared storage."""

    SCHEMA = "id decimal(20,0), chunk_id string, work_id string, embedding array<float>, payload string, updated_at timestamp"

    def __init__(self, spark: SparkSession, path: str, vector_size: int, buckets: int = 64):
        self.spark, self.path, self.vector_size, self.buckets = spark, path, vector_size, buckets

    def init(self, recreate: bool = False) -> None:
        tables.create_if_absent(self.spark, self.path, self.SCHEMA, recreate=recreate)

    def rows(self) -> DataFrame:
        return tables.read_table(self.spark, self.path, self.SCHEMA)

    def upsert(self, payload: DataFrame, embeddings: DataFrame) -> None:
        """Payload rows joined to their vectors by ``chunk_id``; a missing or
        wrongly sized vector fails the job."""
        joined = payload.join(embeddings.select("chunk_id", "embedding"), "chunk_id", "left")
        size = F.coalesce(F.size("embedding"), F.lit(-1))
        checked = F.when(size == self.vector_size, F.col("embedding")).otherwise(F.raise_error(F.concat(
            F.lit("vector of unexpected length for "), F.col("chunk_id"))))
        rows = joined.select(point_id("chunk_id").alias("id"), "chunk_id", "work_id",
                             checked.cast("array<float>").alias("embedding"),
                             F.to_json(F.struct(*[c for c in payload.columns])).alias("payload"),
                             F.current_timestamp().alias("updated_at"))
        tables.upsert(self.spark, self.path, self.SCHEMA, rows, "chunk_id", "updated_at", buckets=self.buckets)

    def delete_work(self, work_id: str) -> int:
        one = self.spark.createDataFrame([(work_id,)], "work_id string")
        return tables.delete(self.spark, self.path, self.SCHEMA, one, "chunk_id", match="work_id", buckets=self.buckets)
