"""Why results disagree: root causes, recovery buckets, match matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.functions.coerce import atomic_list
from concordat.functions.rounding import round_numpy
from concordat.functions.similarity import indel_ratio
from concordat.functions.text import as_col, strip
from concordat.operators.evaluate import Aligned

# Recovery labels by derived field, weakest claim first. A later
# label whose fields all overlap replaces an earlier one.
RECOVERY = (
    ((), "Unresolved after derived views"),
    (("species_stripped_richness",), "Recovered by stripped richness"),
    (("gbif_key_stripped_richness",), "Recovered by GBIF-key stripped richness"),
    (("gbif_keys",), "Recovered by GBIF only"),
    (("taxon_broad_group_labels",), "Recovered by broad groups"),
    (("species_richness_counts",), "Recovered by counts"),
    (("species_richness_counts", "taxon_broad_group_labels"), "Recovered by counts + broad groups"),
    (("species_richness_group_keys",), "Recovered by count + group keys"),
)


def comparable_set(value: Column, data_type: str) -> Column:
    """A value as a set of stripped lower-case texts; empty for blanks and NULL."""
    empty = F.array().cast("array<string>")
    if data_type.startswith("array"):
        items = F.transform(F.filter(value, lambda x: x.isNotNull()), lambda x: F.lower(strip(x.cast("string"))))
        return F.coalesce(F.array_distinct(F.filter(items, lambda x: x != "")), empty)
    text = F.lower(strip(value.cast("string")))
    return F.when(text.isin("none", "[]", "nan", "") | text.isNull(), empty).otherwise(F.array(text))


def mismatch_category(truth_set: Column, pred_set: Column, fp: Column, fn: Column) -> Column:
    t, p = F.size(truth_set) > 0, F.size(pred_set) > 0
    return (F.when(~t & p, "GT_empty").when(t & ~p, "empty_pred")
            .when(t & p & ~F.arrays_overlap(truth_set, pred_set), "vocab_gap")
            .when((fp > 0) & (fn == 0), "over_extraction").when((fn > 0) & (fp == 0), "under_extraction")
            .when((fp > 0) & (fn > 0), "mixed").otherwise("other"))


def mismatches(aligned: Aligned) -> DataFrame:
    """Every mismatching record and field with its category."""
    kinds = dict(aligned.wide.dtypes)
    sets = {f"_{p}_{f}": comparable_set(F.col(f"{p}_{f}"), kinds[f"{p}_{f}"]) for f in aligned.fields for p in "tp"}
    wide = aligned.wide.withColumns(sets)
    rows = [F.when(~F.col(f"c_{f}.match"), F.struct(
        F.lit(f).alias("field"), mismatch_category(F.col(f"_t_{f}"), F.col(f"_p_{f}"), F.col(f"c_{f}.fp"),
                                                   F.col(f"c_{f}.fn")).alias("category"),
        *[F.col(f"c_{f}.{c}").alias(c) for c in ("tp", "fp", "fn")])) for f in aligned.fields]
    return wide.select(aligned.key, F.explode(F.array_compact(F.array(*rows))).alias("r")).select(aligned.key, "r.*")


def category_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("field", "category").agg(F.count(F.lit(1)).alias("n"))


def with_record_label(found: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Readable record label: the record's DOI, else its id."""
    labels = index.select(key, F.col("doi").alias("_doi"))
    joined = found.join(labels, key, "left")
    return joined.withColumn("label", F.coalesce(F.nullif(strip("_doi"), F.lit("")), F.col(key).cast("string"))).drop("_doi")


def match_matrix(results: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Record by field: did it match, and how many items agreed (absent is false / zero)."""
    wide = results.groupBy(key).pivot("field", fields).agg(F.bool_or("match").alias("match"), F.sum("tp").alias("tp"))
    return wide.select(key, *[F.coalesce(F.col(f"{f}_match"), F.lit(False)).alias(f"{f}_match") for f in fields],
                       *[F.coalesce(F.col(f"{f}_tp"), F.lit(0)).cast("bigint").alias(f"{f}_tp") for f in fields])


def recovery_buckets(aligned: Aligned) -> DataFrame:
    """For records whose species differ: the derived view that still overlaps.

    Works on the wide frame (one row per record): no pivot, no shuffle.
    """
    label = F.lit(None).cast("string")
    for fields, text in RECOVERY:
        hit = F.lit(True)
        for f in fields:
            hit = hit & (F.col(f"c_{f}.tp") > 0 if f in aligned.fields else F.lit(False))
        label = F.when(hit, text).otherwise(label)
    return aligned.wide.filter(~F.col("c_species.match")).select(aligned.key, label.alias("analysis_bucket"))


def recovery_summary(buckets: DataFrame) -> DataFrame:
    counts = buckets.groupBy("analysis_bucket").agg(F.count(F.lit(1)).alias("records"))
    total = F.sum("records").over(Window.partitionBy())  # over a row for each bucket, in the same query
    return counts.withColumn("share_of_species_mismatches", round_numpy(F.col("records") / total, 3))


# ---- Older label comparison ------------------------------------------------


def outcome_label(truth: Column | str, pred: Column | str) -> Column:
    """TP / FN / FP / TN of two single labels (blank counts as missing)."""
    t, p = as_col(truth), as_col(pred)
    has_t, has_p = F.coalesce(t != "", F.lit(False)), F.coalesce(p != "", F.lit(False))
    return (F.when(has_t & F.coalesce(t == p, F.lit(False)), "TP").when(has_t, "FN").when(has_p, "FP").otherwise("TN"))


def fuzzy_outcome_label(truth: Column | str, pred: Column | str, threshold: int = 80) -> Column:
    t, p = as_col(truth), as_col(pred)
    has_t, has_p = F.coalesce(t != "", F.lit(False)), F.coalesce(p != "", F.lit(False))
    # Whole-number scores, as the older comparison rounded them.
    close = F.round(indel_ratio(t, p)) > threshold
    return (F.when(has_t & has_p & close, "TP").when(has_t, "FN").when(has_p, "FP").otherwise("TN"))


def multilabel_outcomes(truth: Column | str, pred: Column | str) -> Column:
    """One outcome per predicted label."""
    t, p = as_col(truth), as_col(pred)
    has_t = F.coalesce(F.size(t) > 0, F.lit(False))
    return F.transform(p, lambda x: F.when(has_t & F.array_contains(t, x), "TP").when(has_t, "FN")
                       .when(x != "", "FP").otherwise("TN"))


def detail_to_wide(detail: DataFrame, key: str, value: str, fields: list[str]) -> DataFrame:
    """Tidy detail rows back to one row per record, list texts parsed."""
    wide = detail.groupBy(key).pivot("field", fields).agg(F.first(value, ignorenulls=True))
    cell = lambda f: F.when(~strip(f).isin("", "None"), F.when(F.col(f).startswith("["), atomic_list(f)).otherwise(
        F.array(strip(f))))
    return wide.select(key, *[cell(f).alias(f) for f in fields])
