"""Writers. Everything row-shaped is written by the tasks; only small texts are driver-side."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.operators.evaluate import COUNTERS, Aligned, EvalConfig, field_results, metrics_of_results
from concordat.operators.manifest import COLUMNS as MANIFEST_COLUMNS
from concordat.operators.normalize import FEATURES, normalize_features
from concordat.operators.runs import extraction_table, extraction_table_of_maps


# Quotes are doubled, and cells keep the blanks they begin and end with (the writer's default drops them).
CSV_TEXT = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_manifest(df: DataFrame, path: str) -> None:
    """Manifest CSV with the fixed column order; NULL is an empty cell."""
    df.select(*[F.col(c).cast("string").alias(c) for c in MANIFEST_COLUMNS]).write.mode("overwrite").option(
        "header", True).option("nullValue", "").option("emptyValue", "").options(**CSV_TEXT).csv(path)


def write_run_records(records: DataFrame, path: str, run: str) -> None:
    """Run records as Parquet, one partition folder per run; rewriting a run replaces only its folder."""
    records.withColumn("run_id", F.lit(run)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_extraction_csv(records: DataFrame, path: str, *, order: str | None = None) -> None:
    """The extraction table as CSV. Outputs that are maps need ``order``: their keys become columns as they are first seen in it."""
    table = extraction_table_of_maps(records, order) if order else extraction_table(records)
    table.write.mode("overwrite").option("header", True).option("emptyValue", "").options(**CSV_TEXT).csv(path)


def write_evaluation(aligned: Aligned, path: str) -> None:
    """Detail and metrics of a report as JSON lines, with every counter kept.

    The metrics are summed from the counters of the detail as written, so records are compared once.
    """
    spark = aligned.wide.sparkSession
    field_results(aligned).write.mode("overwrite").json(f"{path}/field_results")
    counters = ", ".join(f"{c} int" for c in COUNTERS)
    detail = spark.read.schema(f"field string, match boolean, {counters}").json(f"{path}/field_results")
    metrics_of_results(detail, aligned.fields).write.mode("overwrite").json(f"{path}/field_metrics")
    spark.createDataFrame([(json.dumps(aligned.config.to_dict()),)], "config string").coalesce(1).write.mode(
        "overwrite").json(f"{path}/config")


def read_evaluation(spark: SparkSession, path: str, key: str = "record_id") -> tuple[DataFrame, DataFrame, EvalConfig]:
    """Detail, metrics and configuration of a stored report."""
    from concordat.sources.readers import FIELD_METRICS, FIELD_RESULT

    config = spark.read.schema("config string").json(f"{path}/config").first()["config"]
    return (spark.read.schema(FIELD_RESULT.replace("record_id", key, 1)).json(f"{path}/field_results"),
            spark.read.schema(f"field string, {FIELD_METRICS}, accuracy_raw double, exact_match_rate double").json(f"{path}/field_metrics"), EvalConfig.from_dict(json.loads(config)))


def write_ground_truth(sheet: DataFrame, path: str, subset: DataFrame | None = None) -> None:
    """Normalised annotations as JSON lines, optionally for some ids."""
    if subset is not None:
        sheet = sheet.join(subset.select(F.col(subset.columns[0]).alias("id")), "id", "left_semi")
    from concordat.sources.readers import list_cells

    have = [f for f in FEATURES if f in sheet.columns]
    normalized = normalize_features(list_cells(sheet))
    normalized.select(F.col("id").cast("bigint").alias("gt_record_id"), *have).write.mode("overwrite").option(
        "ignoreNullFields", False).json(path)


def write_embedding_cache(cache: DataFrame, path: str) -> None:
    """JSON-lines cache by work; only the works in ``cache`` are replaced."""
    cache.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("work_id").json(path)


def write_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def append_failures(df: DataFrame, path: str) -> None:
    """Tab-separated log of failed downloads, appended."""
    df.select("doi", "title", "reason").write.mode("append").option("sep", "\t").csv(path)


def write_markdown(df: DataFrame, path: str) -> None:
    """All rows as lines of a pipe table, written by the tasks; the head is a file of its own that sorts first."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("None")), F.lit("|"), F.lit("\\|"))
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")
    head = df.sparkSession.createDataFrame([("| " + " | ".join(x) + " |",) for x in (df.columns, ["---"] * len(df.columns))], "value string")
    head.coalesce(1).write.mode("overwrite").text(f"{path}/part=0")
    df.select(line([cell(c) for c in df.columns])).write.mode("overwrite").text(f"{path}/part=1")


def run_path(name: str | None, output: str | None, root: str = "artifacts/runs", now: datetime | None = None) -> str:
    """Explicit path, or a timestamped name below the runs folder."""
    if output:
        return output
    stamp = (now or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")
    return str(Path(root) / f"{stamp}_{name or 'run'}.json")
