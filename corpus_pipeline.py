"""The corpus pipeline: each stage works on all its predecessor kept, written as Parquet in the shared folder.

``STAGES`` are the stages in order; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from concordat.llm.mixing import mixed
from concordat.llm.packing import pack
from concordat.llm.quality_rules import keep_good
from concordat.llm.secret_scan import redact
from concordat.llm.simhash import keep_first
from concordat.session import CHECKPOINT_CONF, ensure_checkpoint_dir, ship_package


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier fitted on the labels of ``sf_dir``."""
    ship_package(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship_package(spark)
    return keep_first(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what was found to be secret replaced."""
    ship_package(spark)
    return redact(docs)


def weighed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a part taken once more is a row with that part."""
    ship_package(spark)
    return mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in training sequences."""
    ship_package(spark)
    return pack(docs)


STAGES = [("quality rules", good), ("simhash near-dedup", distinct), ("secret scans", clean), ("mixing", weighed),
          ("packing", packed)]

#: A trained classifier, fingerprints, decoding and a tokenizer decide the rows: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; returns the last stage's rows."""
    ensure_checkpoint_dir(spark)
    shared = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    folder = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
