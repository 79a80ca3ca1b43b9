"""Evaluation queries: predictions derived from ``documents`` against ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions.text import words
from concordat.operators import evaluate as ev
from concordat.operators import mismatch as mm
from concordat.plans.base import derived, plain, table

# Truth: labelled documents. Prediction: every document. Each side has a few
# deliberate disagreements, so that all outcome kinds occur.
TRUTH = """
SELECT l.doc_id, d.source, d.text, upper(d.lang) AS lang, CAST(floor(d.n_chars / 1000) AS INT) AS size_class,
       CASE WHEN d.n_chars % 4 = 0 THEN NULL ELSE l.quality END AS quality, l.toxic = 1 AS toxic
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id"""
PRED = """
SELECT d.doc_id, d.source, d.text, CASE WHEN d.n_chars % 5 = 0 THEN 'xx' ELSE d.lang END AS lang,
       CAST(floor((d.n_chars + 90) / 1000) AS INT) AS size_class,
       CASE WHEN d.n_chars % 6 = 0 THEN NULL ELSE CAST(d.n_chars % 2 AS INT) END AS quality,
       d.n_chars % 3 = 0 AS toxic
FROM {documents} d"""
FIELDS = ("lang", "quality", "size_class", "terms", "toxic")
GROUPS = {"core": ("lang", "size_class", "terms"), "modulator": ("quality", "toxic")}
CONFIG = ev.EvalConfig(field_strategies={f: ev.FieldStrategy() for f in FIELDS})


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """``terms`` holds the long words of the whole text; NULL for a text with none.

    They are taken from the documents before any join, so no text is shuffled.
    """
    def with_terms(low: int, high: int) -> dict[str, DataFrame]:
        terms = F.filter(words("text"), lambda w: F.length(w).between(low, high))
        docs = table(spark, sf, "documents").withColumn("terms", F.when(F.size(terms) > 0, terms))
        return {"documents": docs.select("doc_id", "source", "lang", "n_chars", "terms")}

    return (derived(spark, sf, TRUTH.replace("d.text", "d.terms"), with_terms(10, 14)),
            derived(spark, sf, PRED.replace("d.text", "d.terms"), with_terms(9, 12)))


def _aligned(spark: SparkSession, sf: str, **options) -> ev.Aligned:
    truth, pred = _sides(spark, sf)
    return ev.align(truth, pred, "doc_id", config=CONFIG, **options)


_NORM = "list_distinct(list_transform({x}, lambda w: replace(lower(w), 'ß', 'ss')))"
_WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda w: length(w) BETWEEN {low} AND {high})"
_WIDE = f"""
WITH truth AS (SELECT * EXCLUDE (text), CASE WHEN len({_WORDS.format(low=10, high=14)}) > 0 THEN {_WORDS.format(low=10, high=14)} END AS terms
               FROM ({plain(TRUTH)})),
pred AS (SELECT * EXCLUDE (text), CASE WHEN len({_WORDS.format(low=9, high=12)}) > 0 THEN {_WORDS.format(low=9, high=12)} END AS terms
         FROM ({plain(PRED)})),
pairs AS (SELECT coalesce(t.doc_id, p.doc_id) AS doc_id, coalesce(t.source, p.source) AS source,
  t.doc_id IS NOT NULL AND p.doc_id IS NOT NULL AS common,
  t.lang t_lang, p.lang p_lang, t.quality t_quality, p.quality p_quality, t.size_class t_size_class,
  p.size_class p_size_class, t.toxic t_toxic, p.toxic p_toxic, t.terms t_terms, p.terms p_terms,
  coalesce({_NORM.format(x='t.terms')}, []) AS nt, coalesce({_NORM.format(x='p.terms')}, []) AS np
  FROM truth t FULL JOIN pred p ON t.doc_id = p.doc_id),
"""


def _scalar(field: str, fold: bool = False) -> str:
    t, p = f"t_{field}", f"p_{field}"
    equal = f"lower({t}) = lower({p})" if fold else f"{t} = {p}"
    text = lambda c: f"CAST({c} AS VARCHAR)"
    return f"""SELECT doc_id, source, common, '{field}' AS field, {text(t)} AS true_value, {text(p)} AS pred_value,
  CASE WHEN {t} IS NULL AND {p} IS NULL THEN true WHEN {t} IS NULL OR {p} IS NULL THEN false ELSE {equal} END AS match,
  CAST(coalesce({equal}, false) AS INT) AS tp,
  CAST({p} IS NOT NULL AND NOT coalesce({equal}, false) AS INT) AS fp,
  CAST({t} IS NOT NULL AND NOT coalesce({equal}, false) AS INT) AS fn,
  CAST({t} IS NULL AND {p} IS NULL AS INT) AS tn FROM pairs"""


_LONG = _WIDE + f"""
inter AS (SELECT *, len(list_intersect(nt, np)) AS k FROM pairs),
detail AS ({_scalar('lang', True)} UNION ALL {_scalar('quality')} UNION ALL {_scalar('size_class')}
  UNION ALL {_scalar('toxic')} UNION ALL
  SELECT doc_id, source, common, 'terms', CAST(to_json(t_terms) AS VARCHAR), CAST(to_json(p_terms) AS VARCHAR),
    k = len(np) AND k = len(nt), CAST(k AS INT), CAST(len(np) - k AS INT), CAST(len(nt) - k AS INT),
    CAST(t_terms IS NULL AND p_terms IS NULL AS INT) FROM inter)"""

_SUMS = """CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
  CAST(sum(tn) AS BIGINT) AS tn"""
_RATIOS = """tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall,
  CASE WHEN tp > 0 THEN 2.0 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END AS f1,
  (tp + tn) / n AS accuracy_raw, exact_matches / n AS exact_match_rate"""


def _metrics_sql(by: str = "", where: str = "true") -> str:
    return f"""counts AS (SELECT {by} field, {_SUMS}, count(*) AS n, count(*) FILTER (match) AS exact_matches
  FROM detail WHERE {where} GROUP BY {by} field),
metrics AS (SELECT {by} field, tp, fp, fn, tn, n, exact_matches, {_RATIOS} FROM counts)"""


def _report_sql(by: str = "", where: str = "true") -> str:
    group = f"GROUP BY {by.rstrip(', ')}" if by else ""
    return _LONG + "," + _metrics_sql(by, where) + f""",
micro AS (SELECT {by} '__micro__' AS field, {_SUMS}, CAST(sum(n) AS BIGINT) AS n,
  CAST(sum(exact_matches) AS BIGINT) AS exact_matches FROM counts {group})
SELECT * FROM metrics UNION ALL
SELECT {by} field, tp, fp, fn, tn, n, exact_matches, {_RATIOS} FROM micro UNION ALL
SELECT {by} '__macro_f1__', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, avg(f1), NULL, NULL FROM metrics {group}"""


def eval_field_results(spark, sf):
    return ev.field_results(_aligned(spark, sf))


def eval_field_metrics(spark, sf):
    return ev.field_metrics(_aligned(spark, sf))


def eval_micro_macro(spark, sf):
    return ev.report(_aligned(spark, sf))


def eval_by_source_rollup(spark, sf):
    return ev.report(_aligned(spark, sf, carry=["source"]), by=["source"])


def eval_group_rollup(spark, sf):
    return ev.group_rollup(ev.field_counts(_aligned(spark, sf)), GROUPS)


def eval_common_ids(spark, sf):
    """Only records present on both sides, undefined ratios counted as zero."""
    return ev.field_metrics(_aligned(spark, sf, how="inner"), zero_division=0.0)


def eval_best_worst(spark, sf):
    return ev.best_and_worst(ev.field_metrics(_aligned(spark, sf)))


def eval_errors_for_field(spark, sf):
    return ev.errors_for_field(ev.field_results(_aligned(spark, sf, fields=["size_class"])), "size_class")


def eval_duplicates_last_wins(spark, sf):
    """Several predictions per document (one per conversation turn): the last one counts."""
    turns = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("role").alias("lang"), F.col("turn").alias("ordinal"))
    truth = table(spark, sf, "labels").select("doc_id", F.lit("user").alias("lang"), F.lit(0).alias("ordinal"))
    config = ev.EvalConfig(field_strategies={"lang": ev.FieldStrategy()})
    return ev.field_metrics(ev.align(truth, turns, "doc_id", config=config, order="ordinal"))


def mismatch_categories(spark, sf):
    return mm.category_counts(mm.mismatches(_aligned(spark, sf)))


def mismatch_labels(spark, sf):
    """Mismatches with a readable record label from a record index."""
    index = derived(spark, sf, _INDEX)
    return mm.with_record_label(mm.mismatches(_aligned(spark, sf)), index, "doc_id").select(
        "doc_id", "field", "category", "label")


def match_matrix(spark, sf):
    return mm.match_matrix(ev.field_results(_aligned(spark, sf)), "doc_id", list(FIELDS))


def detail_to_wide(spark, sf):
    """Tidy detail pivoted back to one row per record."""
    detail = ev.field_results(_aligned(spark, sf))
    wide = mm.detail_to_wide(detail, "doc_id", "true_value", ["lang", "quality", "terms"])
    return wide.select("doc_id", F.array_join("lang", "|").alias("lang"), F.array_join("quality", "|").alias("quality"),
                       F.size("terms").alias("n_terms"), F.array_join("terms", "|").alias("terms"))


_INDEX = "SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN '  ' WHEN n_chars % 3 = 1 THEN '10.5061/' || source END AS doi FROM {documents}"
_SETS = """CASE WHEN true_value IS NULL THEN [] WHEN field = 'terms' THEN list_distinct(list_transform(CAST(true_value AS JSON)::VARCHAR[], lambda w: lower(w)))
  ELSE [lower(true_value)] END AS ts,
  CASE WHEN pred_value IS NULL THEN [] WHEN field = 'terms' THEN list_distinct(list_transform(CAST(pred_value AS JSON)::VARCHAR[], lambda w: lower(w)))
  ELSE [lower(pred_value)] END AS ps"""
_CATEGORY = _LONG + f""", found AS (SELECT doc_id, field, CASE WHEN len(ts) = 0 AND len(ps) > 0 THEN 'GT_empty'
  WHEN len(ps) = 0 AND len(ts) > 0 THEN 'empty_pred' WHEN len(ts) > 0 AND len(ps) > 0 AND NOT list_has_any(ts, ps) THEN 'vocab_gap'
  WHEN fp > 0 AND fn = 0 THEN 'over_extraction' WHEN fn > 0 AND fp = 0 THEN 'under_extraction'
  WHEN fp > 0 AND fn > 0 THEN 'mixed' ELSE 'other' END AS category
  FROM (SELECT *, {_SETS} FROM detail WHERE NOT match))"""

QUERIES = {f.__name__: f for f in (
    eval_field_results, eval_field_metrics, eval_micro_macro, eval_by_source_rollup, eval_group_rollup, eval_common_ids,
    eval_best_worst, eval_errors_for_field, eval_duplicates_last_wins, mismatch_categories, mismatch_labels, match_matrix,
    detail_to_wide)}

ORACLE = {
    "eval_field_results": _LONG + " SELECT doc_id, field, true_value, pred_value, match, tp, fp, fn, tn FROM detail",
    "eval_field_metrics": _LONG + "," + _metrics_sql() + " SELECT * FROM metrics",
    "eval_micro_macro": _report_sql(),
    "eval_by_source_rollup": _report_sql("source, "),
    "eval_group_rollup": _LONG + "," + _metrics_sql() + f""", rolled AS (
      SELECT CASE WHEN field IN ('lang', 'size_class', 'terms') THEN 'core' ELSE 'modulator' END AS field_group, * FROM counts),
      sums AS (SELECT field_group, field, {_SUMS}, CAST(sum(n) AS BIGINT) AS n, CAST(sum(exact_matches) AS BIGINT) AS exact_matches
      FROM rolled GROUP BY ROLLUP (field_group, field))
      SELECT field_group, field, tp, fp, fn, tn, n, exact_matches, {_RATIOS} FROM sums""",
    "eval_common_ids": _LONG + "," + _metrics_sql(where="common") + """ SELECT * REPLACE (coalesce(precision, 0) AS precision,
      coalesce(recall, 0) AS recall, coalesce(f1, 0) AS f1) FROM metrics""",
    "eval_best_worst": _LONG + "," + _metrics_sql() + """ SELECT arg_min(field, (-coalesce(f1, 0), field)) AS best_field,
      max(coalesce(f1, 0)) AS best_f1, arg_min(field, (coalesce(f1, 0), field)) AS worst_field, min(coalesce(f1, 0)) AS worst_f1 FROM metrics""",
    "eval_errors_for_field": _LONG + """ SELECT doc_id, field, true_value, pred_value, match, tp, fp, fn, tn FROM detail
      WHERE field = 'size_class' AND NOT match""",
    "eval_duplicates_last_wins": f"""WITH pred AS (SELECT conv_id AS doc_id, arg_max(role, turn) AS lang FROM conversations GROUP BY conv_id),
      counts AS (SELECT CAST(count(*) FILTER (l.doc_id IS NOT NULL AND p.lang = 'user') AS BIGINT) AS tp,
        count(*) FILTER (p.doc_id IS NOT NULL AND (l.doc_id IS NULL OR p.lang <> 'user')) AS fp,
        count(*) FILTER (l.doc_id IS NOT NULL AND (p.doc_id IS NULL OR p.lang <> 'user')) AS fn,
        CAST(0 AS BIGINT) AS tn, count(*) AS n, count(*) FILTER (l.doc_id IS NOT NULL AND p.lang = 'user') AS exact_matches
        FROM labels l FULL JOIN pred p ON l.doc_id = p.doc_id)
      SELECT 'lang' AS field, tp, fp, fn, tn, n, exact_matches, {_RATIOS} FROM counts""",
    "mismatch_categories": _CATEGORY + " SELECT field, category, count(*) AS n FROM found GROUP BY ALL",
    "mismatch_labels": _CATEGORY + f""" SELECT f.doc_id, f.field, f.category,
      coalesce(nullif(trim(i.doi), ''), CAST(f.doc_id AS VARCHAR)) AS label FROM found f LEFT JOIN ({plain(_INDEX)}) i ON f.doc_id = i.doc_id""",
    "match_matrix": _LONG + " SELECT doc_id, " + ", ".join(
        f"bool_or(match) FILTER (field = '{f}') AS {f}_match, CAST(sum(tp) FILTER (field = '{f}') AS BIGINT) AS {f}_tp"
        for f in FIELDS) + " FROM detail GROUP BY doc_id",
    "detail_to_wide": _WIDE.rstrip().rstrip(",") + """ SELECT doc_id, t_lang AS lang, CAST(t_quality AS VARCHAR) AS quality,
      CAST(len(t_terms) AS INT) AS n_terms, array_to_string(t_terms, '|') AS terms FROM pairs""",
}
