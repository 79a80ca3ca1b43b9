"""Helpers shared by the query catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run dialect-neutral SQL that names tables as ``{name}``; the oracle runs
    the same text with the bare names, so both sides start from equal rows.
    ``given`` are frames that stand in for tables."""
    used = {name: (given or {}).get(name) for name in TABLES if "{" + name + "}" in sql}
    used = {name: table(spark, sf_dir, name) if df is None else df for name, df in used.items()}
    return spark.sql(sql, **used)


def plain(sql: str) -> str:
    """The same derivation for the oracle engine."""
    return sql.format(**{name: name for name in TABLES})
