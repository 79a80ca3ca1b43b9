"""Rule-based relevance scoring and classification reports."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.coerce import is_true_label
from concordat.functions.rounding import round_numpy
from concordat.functions.text import as_col, strip

# Labels from best to worst, rank of each, modulator fields.
LABELS = ("H", "M", "L", "X")
RANK = {"H": 3, "M": 2, "L": 1, "X": 0}
MODULATORS = ("multispecies", "threatened_species", "new_species_science", "new_species_region", "bias_north_south")


def recode_label(value: Column | str) -> Column:
    """Manual labels: ``No dataset`` counts as X, blanks are trimmed."""
    v = as_col(value)
    return F.when(v == "No dataset", "X").otherwise(strip(v))


def labelled(df: DataFrame, column: str) -> DataFrame:
    """Rows whose label is one of the four."""
    return df.filter(F.col(column).isin(*LABELS))


def data_type_score(raw: Column | str, primary: Column | str) -> Column:
    """Score of the data type: the raw text decides where it is explicit, else the
    normalised primary type. Plain genetic analysis is low unless EBV is named."""
    t = strip(F.lower(as_col(raw)))
    n = strip(F.lower(as_col(primary)))
    has = lambda *parts: F.lit(False) if not parts else _any([t.contains(p) for p in parts])
    genetic_only = t.contains("genetic analysis") & ~t.contains("ebv genetic")
    from_raw = (F.when(t.isin("other", "unknown"), "X")
                .when(t.contains("non-ebv") | genetic_only, "L")
                .when(has("relative abundance", "species richness", "species_richness"), "L")
                .when(has("abundance", "density", "ebv genetic"), "H")
                .when(has("distribution", "presence-absence", "presence_absence"), "M")
                .when(has("presence"), "L"))
    from_primary = (F.when(n.isin("abundance", "density"), "H")
                    .when(n.isin("distribution", "presence-absence"), "M")
                    .when(n.isin("genetic_analysis", "presence-only", "species_richness"), "L")
                    .otherwise("X"))
    readable = t.isNotNull() & ~t.isin("", "nan")
    return F.when(readable, F.coalesce(from_raw, from_primary)).otherwise(from_primary)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def temporal_score(start: Column | str, end: Column | str) -> Column:
    """Inclusive years: 12 and more high, 3 and more medium, fewer low, unknown X."""
    years = as_col(end).cast("double") - as_col(start).cast("double") + 1
    known = years.isNotNull() & ~F.isnan(years)
    return F.when(known & (years >= 12), "H").when(known & (years >= 3), "M").when(known, "L").otherwise("X")


def spatial_score(km2: Column | str) -> Column:
    area = as_col(km2).cast("double")
    known = area.isNotNull() & ~F.isnan(area)
    return F.when(known & (area > 15000), "H").when(known & (area >= 5000), "M").when(known, "L").otherwise("X")


def _rank(label: Column) -> Column:
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in RANK.items()))
    return F.try_element_at(table, label)


def majority_vote(data_type: Column, temporal: Column, spatial: Column) -> Column:
    """Two equal scores win; otherwise the data type caps the better range score,
    and a high data type next to an unknown range is low."""
    best_range = F.when(_rank(temporal) >= _rank(spatial), temporal).otherwise(spatial)
    return (F.when((data_type == temporal) | (data_type == spatial), data_type)
            .when(temporal == spatial, temporal)
            .when((data_type == "H") & ((temporal == "X") | (spatial == "X")), "L")
            .when(_rank(data_type) <= _rank(best_range), data_type).otherwise(best_range))


def apply_modulators(label: Column, modulated: Column) -> Column:
    """Exactly one level up when any modulator is true."""
    raised = F.when(label == "X", "L").when(label == "L", "M").when(label.isin("M", "H"), "H").otherwise(label)
    return F.when(modulated, raised).otherwise(label)


def classify(df: DataFrame, *, raw: str = "raw_data_type", primary: str = "data_type_primary") -> DataFrame:
    """Add the three classifier scores, their vote and the modulated label."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    null = F.lit(None).cast("string")
    value = lambda name: F.col(name) if name in kinds else null
    flags = [is_true_label(F.col(m), kinds[m]) for m in MODULATORS if m in kinds]
    scored = df.withColumns({
        "mc_data_type": data_type_score(value(raw), value(primary)),
        "mc_temporal": temporal_score(value("temp_range_i"), value("temp_range_f")),
        "mc_spatial": spatial_score(value("spatial_range_km2")),
    })
    voted = scored.withColumn("mc_relevance", majority_vote(
        F.col("mc_data_type"), F.col("mc_temporal"), F.col("mc_spatial")))
    return voted.withColumn("pred_relevance", apply_modulators(
        F.col("mc_relevance"), _any(flags) if flags else F.lit(False)))


# ---- Reports ---------------------------------------------------------------


def confusion_matrix(df: DataFrame, truth: str, pred: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """True label by predicted label counts, zero-filled, fixed label columns."""
    counts = df.filter(F.col(truth).isin(*labels)).groupBy(F.col(truth).alias("true_label")).pivot(
        pred, list(labels)).agg(F.count(F.lit(1)))
    names = [F.col(label).alias(f"pred_{label}") for label in labels]
    return counts.fillna(0).select("true_label", *names)


def present_labels(df: DataFrame, truth: str, pred: str, *, truth_only: bool = False) -> DataFrame:
    """``(label, present)`` for the four labels; seen in truth, or in either column."""
    seen = lambda label: (F.col(truth) == label) | (F.lit(not truth_only) & (F.col(pred) == label))
    flags = df.agg(*[F.coalesce(F.bool_or(seen(label)), F.lit(False)).alias(label) for label in LABELS])
    rows = [F.struct(F.lit(label).alias("label"), F.col(label).alias("present")) for label in LABELS]
    return flags.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def class_report(df: DataFrame, truth: str, pred: str, *, truth_only: bool = False) -> DataFrame:
    """Per-class precision, recall, F1 and support, zero where undefined.

    One conditional aggregation over all rows; ``present`` marks the labels
    that count for the macro average.
    """
    t, p = F.col(truth), F.col(pred)
    sums = []
    for label in LABELS:
        sums += [F.count_if((t == label) & (p == label)).alias(f"{label}_tp"),
                 F.count_if((t != label) & (p == label)).alias(f"{label}_fp"),
                 F.count_if((t == label) & (p != label)).alias(f"{label}_fn")]
    rows = [F.struct(F.lit(label).alias("label"), *[F.col(f"{label}_{c}").alias(c) for c in ("tp", "fp", "fn")])
            for label in LABELS]
    both = df.filter(t.isNotNull() & p.isNotNull()).agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return _zero_ratios(both.withColumns({
        "support": F.col("tp") + F.col("fn"),
        "present": (F.col("tp") + F.col("fn") > 0) | (F.lit(not truth_only) & (F.col("fp") > 0))}))


def _zero_ratios(df: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    rated = df.withColumns({
        "precision": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), zero),
        "recall": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), zero)})
    return rated.withColumn("f1", F.coalesce(F.try_divide(
        2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), zero))


def macro_over_present(report: DataFrame) -> DataFrame:
    """Macro F1 over present labels and over all four."""
    return report.agg(F.avg(F.when(F.col("present"), F.col("f1"))).alias("macro_f1_present"),
                      F.avg("f1").alias("macro_f1_all"))


def is_relevant(label: Column | str) -> Column:
    """Binary collapse: high and medium are relevant."""
    return as_col(label).isin("H", "M")


def binary_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    t, p = is_relevant(truth), is_relevant(pred)
    return _zero_ratios(df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull()).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn")))


def column_audit(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Agreement of computed columns with annotated ones, row by row where annotated.

    All pairs are counted in one pass.
    """
    sums = []
    for i, (gt, calc) in enumerate(pairs):
        valid = F.col(gt).isin(*LABELS)
        sums += [F.count_if(valid).alias(f"c{i}"), F.count_if(valid & F.col(gt).eqNullSafe(F.col(calc))).alias(f"m{i}")]
    rows = [F.struct(F.lit(gt).alias("gt_column"), F.lit(calc).alias("computed_column"),
                     F.col(f"c{i}").alias("compared"), F.col(f"m{i}").alias("matches")) for i, (gt, calc) in enumerate(pairs)]
    out = df.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.withColumns({"mismatches": F.col("compared") - F.col("matches"),
                            "accuracy": round_numpy(F.try_divide("matches", "compared"), 3)})


def audit_mismatches(df: DataFrame, key: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Every disagreeing (record, column pair) as a row."""
    rows = [F.when(F.col(gt).isin(*LABELS) & ~F.col(gt).eqNullSafe(F.col(calc)),
                   F.struct(F.lit(gt).alias("gt_column"), F.lit(calc).alias("computed_column"),
                            F.col(gt).alias("gt_value"), F.col(calc).alias("computed_value")))
            for gt, calc in pairs]
    return df.select(key, F.explode(F.array_compact(F.array(*rows))).alias("r")).select(key, "r.*")


def prediction_delta(part_a: DataFrame, part_b: DataFrame, key: str, truth: str = "gt_relevance",
                     pred: str = "pred_relevance") -> DataFrame:
    """Two prediction sets side by side on their shared records."""
    a = part_a.select(key, F.col(truth).alias(truth), F.col(pred).alias("pred_a"))
    b = part_b.select(key, F.col(pred).alias("pred_b"))
    joined = a.join(b, key)
    return joined.withColumns({
        "same": F.col("pred_a").eqNullSafe(F.col("pred_b")),
        "a_correct": F.col("pred_a").eqNullSafe(F.col(truth)),
        "b_correct": F.col("pred_b").eqNullSafe(F.col(truth))})


def delta_summary(delta: DataFrame) -> DataFrame:
    a, b = F.col("a_correct"), F.col("b_correct")
    return delta.agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("same"), F.count_if(a).alias("a_correct"),
                     F.count_if(b).alias("b_correct"), F.count_if(a & ~b).alias("degraded"),
                     F.count_if(~a & b).alias("improved"))
