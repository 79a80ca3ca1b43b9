"""Extraction runs: cost and token KPIs, fill rates, comparisons and trends."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from concordat.functions import coerce, cost
from concordat.functions.rounding import round_exact, round_numpy
from concordat.functions.text import is_blank, is_populated
from concordat.operators.evaluate import MACRO, MICRO

# Base columns of the extraction CSV, run modes and their input.
CSV_BASE = ("gt_record_id", "record_id", "mode", "status", "title", "extraction_method", "cost_usd",
            "error_message", "pdf_path")
MODES = {"abstract": ("abstract", "Missing abstract.", "abstract_text"),
         "pdf_text": ("pdf_local_path", "Missing pdf_local_path.", "pdf_text"),
         "pdf_native": ("pdf_local_path", "Missing pdf_local_path.", "pdf_native"),
         "sections": ("pdf_local_path", "Missing pdf_local_path.", "sections")}


def run_records(manifest: DataFrame, mode: str, extractions: DataFrame) -> DataFrame:
    """One run record per manifest row: success, skipped or error.

    ``extractions`` is the staged output of the external extractor
    (``gt_record_id, output, usage_cost, error``). A record without its input
    is skipped; one whose extractor failed, or gave nothing, is an error.
    """
    source, missing, method = MODES[mode]
    staged = extractions.select("gt_record_id", "output", "usage_cost", "error")
    joined = manifest.join(staged, "gt_record_id", "left")
    no_input = is_blank(source)
    failed = F.col("error").isNotNull() | F.col("output").isNull()
    status = F.when(no_input, "skipped").when(failed, "error").otherwise("success")
    ok = status == "success"
    return joined.select(
        "gt_record_id", F.coalesce(F.nullif("article_doi", F.lit("")), F.nullif("source_doi", F.lit("")),
                                   F.col("gt_record_id").cast("string")).alias("record_id"),
        F.lit(mode).alias("mode"), status.alias("status"),
        F.when(no_input, missing).when(failed, F.coalesce("error", F.lit("no output"))).alias("error_message"),
        "title", "abstract", F.col("pdf_local_path").alias("pdf_path"), F.when(ok, method).alias("extraction_method"),
        F.when(ok, F.col("usage_cost")).alias("usage_cost"), F.when(ok, F.col("output")).alias("output"))


def extract_with(records: DataFrame, text: str, extractor: Callable[[str], dict], output_schema: str) -> DataFrame:
    """Call an extractor inside the tasks; an exception marks only its own record."""
    kept = records.select("gt_record_id", F.col(text).alias("_text")).filter(~is_blank("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs, errors = [], []
            for value in batch.column("_text").to_pylist():
                try:
                    outputs.append(extractor(value))
                    errors.append(None)
                except Exception as problem:  # noqa: BLE001 - isolation per record is the contract
                    outputs.append(None)
                    errors.append(f"{type(problem).__name__}: {problem}")
            yield pa.RecordBatch.from_arrays([batch.column("gt_record_id"), pa.array(outputs, output_type),
                                              pa.array(errors, pa.string())], names=["gt_record_id", "output", "error"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    output_type = to_arrow_type(StructType.fromDDL(output_schema))
    key = dict(kept.dtypes)["gt_record_id"]
    return kept.mapInArrow(run, f"gt_record_id {key}, output struct<{output_schema}>, error string")


def predictions(records: DataFrame) -> DataFrame:
    """Features of the successful records, keyed by id."""
    return records.filter((F.col("status") == "success") & F.col("output").isNotNull()).select(
        "gt_record_id", "output.*")


def with_cost_columns(records: DataFrame, model: Column | str) -> DataFrame:
    """Cache status, tokens and cost columns of every run record."""
    u = lambda n: F.col(f"usage_cost.{n}")
    what_if = cost.what_if_cost(model, u("input_tokens"), u("output_tokens"))
    memo = F.coalesce(u("memo_hit"), F.lit(False))
    return records.withColumns({
        "cache_status": cost.cache_status(memo, u("cached_tokens")),
        "cached_tokens": u("cached_tokens"),
        "input_tokens_used": cost.input_tokens_used(u("input_tokens"), u("cached_tokens")),
        "input_tokens_value": u("input_tokens"),
        "cost_used_usd": u("total_cost"), "cost_value_usd": what_if,
        "cache_savings_usd": cost.savings(what_if, u("total_cost"))})


def populated_fields(records: DataFrame, column: str = "output") -> Column:
    """How many fields of the output struct carry a value."""
    fields = records.schema[column].dataType.fields
    flags = [F.coalesce(is_populated(F.col(f"{column}.{f.name}"), f.dataType.simpleString()), F.lit(False)).cast("int")
             for f in fields]
    return sum(flags[1:], flags[0])


def run_kpis(records: DataFrame, model: Column | str, by: list[str] | None = None) -> DataFrame:
    """All run indicators in one aggregation."""
    costed = with_cost_columns(records, model).withColumn("_filled", populated_fields(records))
    success = F.col("status") == "success"
    used = success & F.col("usage_cost").isNotNull()
    only = lambda c: F.when(used, F.coalesce(F.col(c), F.lit(0)))
    out = costed.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_records"), F.count_if(success).alias("success_count"),
        F.count_if(F.col("status") == "skipped").alias("skipped_count"),
        F.count_if(F.col("status") == "error").alias("error_count"), F.count("output").alias("output_count"),
        F.count_if(used & F.col("cache_status").isin("hit", "memo_hit")).alias("cache_hits"),
        F.count_if(used & (F.col("cache_status") == "miss")).alias("cache_misses"),
        F.sum(only("input_tokens_used")).alias("input_tokens_used"),
        F.sum(only("input_tokens_value")).alias("input_tokens_value"),
        F.sum(only("cached_tokens")).alias("cached_tokens"),
        round_exact(F.sum(only("cost_used_usd")), 4).alias("cost_used_usd"),
        round_exact(F.sum(F.when(used, F.col("cost_value_usd"))), 4).alias("cost_value_usd"),
        F.avg(F.when(used, F.col("cost_value_usd"))).alias("avg_cost_value_usd"),
        F.avg(F.when(success, F.coalesce(F.col("_filled"), F.lit(0)))).alias("avg_populated_fields"))
    return out.withColumn("cache_savings_usd", round_exact(F.col("cost_value_usd") - F.col("cost_used_usd"), 4))


def total_cost(records: DataFrame) -> DataFrame:
    return records.agg(round_exact(F.sum(F.coalesce("usage_cost.total_cost", F.lit(0.0))), 4).alias("total_cost_usd"))


def cost_by(records: DataFrame, by: list[str]) -> DataFrame:
    """Sums and means of cost and tokens per group, successes only."""
    u = lambda n: F.coalesce(F.col(f"usage_cost.{n}"), F.lit(0))
    return records.filter(F.col("status") == "success").groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"), F.sum(u("total_cost")).alias("total_cost"),
        F.avg(u("total_cost")).alias("avg_cost"), F.sum(u("input_tokens")).alias("input_tokens"),
        F.sum(u("output_tokens")).alias("output_tokens"), F.avg(u("input_tokens")).alias("avg_input_tokens"),
        F.avg(u("output_tokens")).alias("avg_output_tokens"))


def fill_rate(records: DataFrame, column: str = "output") -> DataFrame:
    """Share of successful records with a value, per output field. One pass."""
    fields = records.schema[column].dataType.fields
    sums = [F.count_if(is_populated(F.col(f"{column}.{f.name}"), f.dataType.simpleString())).alias(f"f{i}")
            for i, f in enumerate(fields)]
    totals = records.filter(F.col("status") == "success").agg(F.count(F.lit(1)).alias("success_records"), *sums)
    rows = [F.struct(F.lit(f.name).alias("field"), F.col(f"f{i}").alias("records_with_value"), F.col("success_records"),
                     round_exact(F.try_divide(F.col(f"f{i}"), "success_records"), 3).alias("fill_rate"))
            for i, f in enumerate(fields)]
    flat = totals.filter("success_records > 0").select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return flat.orderBy(F.desc("fill_rate"), "field")


def extraction_table(records: DataFrame, column: str = "output") -> DataFrame:
    """Rows of the extraction CSV: base columns, then the output fields, all as cell text."""
    kinds = {f.name: f.dataType.simpleString() for f in records.schema[column].dataType.fields}
    extra = [coerce.csv_cell(F.col(f"{column}.{n}"), k).alias(n) for n, k in kinds.items() if n not in CSV_BASE]
    return records.select(*_csv_base(records), *extra)


def _csv_base(records: DataFrame) -> list[Column]:
    """The base columns as cell text; those the records do not have are empty."""
    own = set(records.columns)
    sources = {"cost_usd": F.col("usage_cost.total_cost")} if "usage_cost" in own else {}
    sources |= {n: F.col(n) for n in CSV_BASE if n in own and n not in sources}
    return [coerce.csv_cell(sources.get(n, F.lit(None).cast("string")), "string").alias(n) for n in CSV_BASE]


def output_keys(records: DataFrame, order: str, column: str = "output") -> DataFrame:
    """Keys of free-form map outputs in first-seen order (one row per distinct key)."""
    keys = records.filter(F.col(column).isNotNull()).select(order, F.posexplode(F.map_keys(column)).alias("pos", "field"))
    return keys.groupBy("field").agg(F.min(F.struct(order, "pos")).alias("_first")).orderBy("_first").select("field")


def normalize_reasoning(reasoning: Column, effort: Column) -> Column:
    """The effort, from the separate column, the JSON or the plain spelling, in that order."""
    given = F.nullif(F.btrim(effort), F.lit(""))
    text = F.btrim(reasoning)
    as_json = text.startswith("{")
    inner = F.nullif(F.btrim(F.get_json_object(text, "$.effort")), F.lit(""))
    plain = F.when(~as_json, F.nullif(text, F.lit("")))
    return F.coalesce(given, F.when(as_json, inner), plain)


def reasoning_settings(reasoning: Column, effort: Column) -> Column:
    """``struct(reasoning map<string,string>, effort)`` of a run, from the JSON object, the plain spelling or the effort alone.

    The object keeps its other settings; its own effort is trimmed, not replaced by the separate one.
    """
    as_json = F.btrim(reasoning).startswith("{")
    given = F.from_json(F.when(as_json, reasoning), "map<string,string>")
    own = F.nullif(F.btrim(F.try_element_at(given, F.lit("effort"))), F.lit(""))
    kept = F.when(own.isNull(), given).otherwise(F.map_concat(F.map_filter(given, lambda k, _: k != "effort"), F.create_map(F.lit("effort"), own)))
    plain = F.nullif(F.btrim(F.when(~as_json, reasoning)), F.lit(""))
    separate = F.nullif(F.btrim(effort), F.lit(""))
    alone = F.when(reasoning.isNull(), separate)
    text = F.coalesce(plain, alone)
    settings = F.when(as_json, kept).when(text.isNotNull(), F.create_map(F.lit("effort"), text))
    return F.struct(settings.alias("reasoning"), F.coalesce(separate, own, plain).alias("effort"))


# ---- Comparing runs --------------------------------------------------------

RATIOS = ("precision", "recall", "f1")


def compare_runs(metrics_a: DataFrame, metrics_b: DataFrame) -> DataFrame:
    """Fields of two runs side by side with rounded deltas, regressions first."""
    a = metrics_a.select("field", F.col("n").alias("n_a"), *[F.col(m).alias(f"{m}_a") for m in RATIOS])
    b = metrics_b.select("field", *[F.col(m).alias(f"{m}_b") for m in RATIOS])
    joined = a.join(b, "field").withColumns(
        {f"delta_{m}": round_numpy(F.col(f"{m}_b") - F.col(f"{m}_a"), 3) for m in RATIOS})
    return joined.orderBy(F.asc_nulls_last("delta_f1"), "field")


def overall_deltas(report: DataFrame, baseline: DataFrame) -> DataFrame:
    """Micro ratios and macro F1 of a report against a baseline, and how uniform fields are.

    Both inputs are reports with the two summary rows.
    """
    def tagged(df: DataFrame, tag: str) -> DataFrame:
        return df.filter(F.col("field").isin(MICRO, MACRO)).select(F.lit(tag).alias("_side"), "field", *RATIOS)

    def at(tag: str, row: str, m: str) -> Column:
        return F.max(F.when((F.col("_side") == tag) & (F.col("field") == row), F.col(m)))

    # Two summary rows per report, stacked and turned into one row: no join needed.
    picked = [at(tag, MICRO, m).alias(f"micro_{m}{tag}") for tag in ("", "_base") for m in RATIOS]
    picked += [at(tag, MACRO, "f1").alias(f"macro_f1{tag}") for tag in ("", "_base")]
    joined = tagged(report, "").unionByName(tagged(baseline, "_base")).agg(*picked)
    names = [f"micro_{m}" for m in RATIOS] + ["macro_f1"]
    gap = F.col("micro_f1") - F.col("macro_f1")
    return joined.withColumns({**{f"delta_{n}": round_exact(F.col(n) - F.col(f"{n}_base"), 3) for n in names},
                               "balance": F.when(F.abs(gap) < 0.05, "uniform").when(gap > 0, "common_fields_better")
                               .when(gap.isNotNull(), "rare_fields_better")})


def trend_rows(reports: DataFrame, run: str = "run", mode: str = "mode", modes: list[str] | None = None) -> DataFrame:
    """Ratio rows per run and field with the run's name timestamp, optionally for some modes."""
    kept = reports.filter(F.col(mode).isin(*modes)) if modes else reports
    return kept.select(run, F.substring(F.col(run), 1, 15).alias("timestamp"), mode, "field", *RATIOS)


def trend_pivot(trends: DataFrame, fields: list[str], value: str = "f1", run: str = "run") -> DataFrame:
    """Run by field matrix in time order."""
    return trends.groupBy("timestamp", run).pivot("field", fields).agg(F.first(value)).orderBy("timestamp", run)


def digest(value: Column | str) -> Column:
    """SHA-256 hex of a text (provenance of inputs)."""
    return F.sha2(value, 256)


def table_digest(df: DataFrame, key: str) -> DataFrame:
    """One digest for a whole table, independent of row order and partitioning.

    Row digests are folded by a commutative sum, so nothing is collected or sorted.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    parts = [F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = df.agg(F.count(key).alias("rows"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)])
    return sums.select("rows", F.sha2(F.concat_ws("|", "rows", *[f"s{i}" for i in range(4)]), 256).alias("digest"))


# ---- Map outputs and outcomes ----------------------------------------------


def extraction_table_of_maps(records: DataFrame, order: str, column: str = "output") -> DataFrame:
    """Rows of the extraction CSV for free-form outputs (maps of texts): base columns, then a column for each key.

    Two passes: the first finds the keys in the order they are first seen, by
    ``order`` and place in the map; the second widens every row. The driver
    holds the keys, which are the columns of the result.
    """
    keys = [r["field"] for r in output_keys(records, order, column).collect() if r["field"] not in CSV_BASE]
    extra = [coerce.csv_cell(F.try_element_at(column, F.lit(k)), "string").alias(k) for k in keys]
    return records.select(*_csv_base(records), *extra)


@dataclass(frozen=True)
class Split:
    """Both sides of a job's outcomes, as stored, and how many there are."""

    succeeded: DataFrame
    failed: DataFrame
    n_succeeded: int
    n_failed: int


def split_outcomes(df: DataFrame, ok: Column, path: str) -> Split:
    """Write rows to ``path`` apart by whether they succeeded, in one job that runs the work once.

    The counts are observed while the rows are written; a NULL outcome is a failure.
    """
    counts = Observation()
    good = F.coalesce(ok, F.lit(False))
    marked = df.withColumn("outcome", F.when(good, "succeeded").otherwise("failed"))
    marked = marked.observe(counts, F.count_if(F.col("outcome") == "succeeded").alias("n_succeeded"),
                            F.count_if(F.col("outcome") == "failed").alias("n_failed"))
    marked.write.mode("overwrite").partitionBy("outcome").parquet(path)
    stored = df.sparkSession.read.schema(marked.schema).parquet(path)
    side = lambda name: stored.where(F.col("outcome") == name).drop("outcome")
    return Split(side("succeeded"), side("failed"), counts.get["n_succeeded"], counts.get["n_failed"])
