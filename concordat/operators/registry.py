"""Document and chunk registry: status machine, upserts, cascade delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.operators import tables

# Processing states in order, and the two table layouts.
STATUSES = ("PENDING", "PARSED", "CHUNKED", "INDEXED", "ERROR")
DOCUMENTS = ("work_id string, pdf_sha256 string, source_path string, doi string, title string, "
             "publication_year int, status string, parser_version string, error_message string, updated_at timestamp")
CHUNKS = ("chunk_id string, work_id string, section_id string, chunk_index_in_section int, "
          "vector_indexed boolean, updated_at timestamp")
CHUNK_UPDATABLE = ["vector_indexed", "updated_at"]


class Registry:
    """Two keyed tables under one folder on shared storage."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.documents_path, self.chunks_path = f"{root}/documents", f"{root}/chunks"

    def init(self, recreate: bool = False) -> None:
        tables.create_if_absent(self.spark, self.documents_path, DOCUMENTS, recreate=recreate)
        tables.create_if_absent(self.spark, self.chunks_path, CHUNKS, recreate=recreate)

    def documents(self) -> DataFrame:
        return tables.read_table(self.spark, self.documents_path, DOCUMENTS)

    def chunks(self) -> DataFrame:
        return tables.read_table(self.spark, self.chunks_path, CHUNKS)

    def document(self, work_id: str) -> DataFrame:
        return self.documents().filter(F.col("work_id") == work_id)

    def by_status(self, status: str) -> DataFrame:
        return self.documents().filter(F.col("status") == status)

    def chunks_of(self, work_id: str) -> DataFrame:
        return self.chunks().filter(F.col("work_id") == work_id)

    def upsert_documents(self, rows: DataFrame) -> None:
        status = F.coalesce("status", F.lit("PENDING"))
        checked = rows.withColumn("status", F.when(status.isin(*STATUSES), status).otherwise(
            F.raise_error(F.concat(F.lit("unknown status "), status))))
        tables.upsert(self.spark, self.documents_path, DOCUMENTS, checked, "work_id", "updated_at", buckets=self.buckets)

    def upsert_chunks(self, rows: DataFrame) -> None:
        """An existing chunk only refreshes its index flag and time."""
        tables.upsert(self.spark, self.chunks_path, CHUNKS, rows, "chunk_id", "updated_at", only=CHUNK_UPDATABLE,
                      buckets=self.buckets)

    def set_status(self, updates: DataFrame) -> None:
        """``updates``: work_id, status, error_message, updated_at. An id that is not registered yet gets a row
        with these columns, so its state is kept."""
        updates = tables.once(updates)
        known = self.documents().drop("status", "error_message", "updated_at")
        self.upsert_documents(updates.join(known, "work_id", "left").select(*self.documents().columns))

    def delete_documents(self, work_ids: DataFrame) -> int:
        """Remove documents and all of their chunks."""
        tables.delete(self.spark, self.chunks_path, CHUNKS, work_ids, "chunk_id", match="work_id", buckets=self.buckets)
        return tables.delete(self.spark, self.documents_path, DOCUMENTS, work_ids, "work_id", buckets=self.buckets)

    def pending(self, candidates: DataFrame, done: tuple[str, ...] = ("INDEXED",)) -> DataFrame:
        """Candidates not yet finished: the idempotent-rerun filter."""
        finished = self.documents().filter(F.col("status").isin(*done)).select("work_id")
        return candidates.join(finished, "work_id", "left_anti")


def sha_collisions(documents: DataFrame) -> DataFrame:
    """Files registered under more than one work id."""
    return documents.groupBy("pdf_sha256").agg(F.count(F.lit(1)).alias("n"), F.min("work_id").alias("first_work_id"),
                                               F.max("work_id").alias("last_work_id")).filter("n > 1")


def cascade(documents: DataFrame, chunks: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the doomed works (pure form of the cascade)."""
    return documents.join(doomed, "work_id", "left_anti"), chunks.join(doomed, "work_id", "left_anti")
