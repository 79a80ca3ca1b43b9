"""Lexical grounding of claimed values in source text, and the comparison table."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.sections import plain_sentences
from concordat.functions.text import ascii_key, clean_markup, let, words

# Field -> claimed value -> cue phrases that support it.
CUES = {
    "data_type": {
        "abundance": ["abundance", "density", "count", "counts", "estimated"],
        "density": ["density", "densities", "isodar"],
        "presence-only": ["presence", "occurrence", "identified", "observed"],
        "presence-absence": ["presence absence", "presence-absence"],
        "genetic_analysis": ["genetic", "microsatellite", "genotyp", "loci"],
        "distribution": ["distribution", "range expansion", "expanding"],
        "traits": ["movement", "fitness", "reproductive success", "behavio"],
        "ecosystem_structure": ["habitat", "landscape composition", "forest edge"],
        "time_series": ["over two years", "successive years", "consecutive years", "2004 2011", "1999 2011"],
    },
    "geospatial_info_dataset": {
        "sample": ["x meter", "y meter", "coordinates", "live trap locations", "sample id"],
        "site": ["river", "region", "regions", "park", "study area", "sites"],
        "maps": ["map", "maps"],
        "administrative_units": ["quebec", "canada", "ontario", "charlevoix", "estrie", "monteregie", "shawinigan"],
        "range": ["range", "home range", "distributional limit"],
        "site_ids": ["sample id", "id"],
    },
}


def keyed_sentences(text: Column) -> Column:
    """Sentences of cleaned text with their matching key."""
    return F.transform(plain_sentences(clean_markup(text)), lambda s: F.struct(
        s.alias("sentence"), ascii_key(s).alias("key")))


def ground_species(value: Column, sentences: Column) -> Column:
    """Explicit when the whole name occurs, paraphrase when enough of its words do."""
    target = ascii_key(value)
    tokens = F.filter(words(target), lambda t: F.length(t) > 2)

    def decide(c: Column) -> Column:
        exact = F.filter(sentences, lambda s: (c["target"] != "") & F.contains(s["key"], c["target"]))
        hits = lambda s: F.size(F.filter(c["tokens"], lambda t: F.contains(s["key"], t)))
        partial = F.filter(sentences, lambda s: (hits(s) > 0) & (hits(s) >= F.least(F.lit(2), F.size(c["tokens"]))))
        found = F.coalesce(F.get(exact, F.lit(0)), F.get(partial, F.lit(0)))
        kind = (F.when(F.size(exact) > 0, "explicit").when(F.size(partial) > 0, "paraphrase").otherwise("unsupported"))
        return F.struct(kind.alias("support_type"), found["sentence"].alias("quote"))

    return let(F.struct(target.alias("target"), tokens.alias("tokens")), decide)


def cue_phrases(field: str, value: Column) -> Column:
    table = F.create_map(*chain.from_iterable(
        (F.lit(name), F.array(*[F.lit(c) for c in cues])) for name, cues in CUES.get(field, {"": [""]}).items()))
    return F.coalesce(F.try_element_at(table, value), F.array().cast("array<string>"))


def ground_cue(field: str, value: Column, sentences: Column) -> Column:
    """Paraphrase when a sentence holds a cue phrase of the value; first sentence wins."""
    keys = F.transform(cue_phrases(field, value), lambda c: ascii_key(c))

    def decide(c: Column) -> Column:
        found = F.filter(sentences, lambda s: F.exists(c["keys"], lambda k: F.contains(s["key"], k)))
        hit = F.get(found, F.lit(0))
        return F.struct(F.when(F.size(found) > 0, "paraphrase").otherwise("unsupported").alias("support_type"),
                        hit["sentence"].alias("quote"))

    return let(F.struct(keys.alias("keys")), decide)


def ground(field: str, value: Column, sentences: Column) -> Column:
    """``struct(support_type, quote)``; NULL fields when there is no claim."""
    found = ground_species(value, sentences) if field == "species" else ground_cue(field, value, sentences)
    return F.when(F.coalesce(value != "", F.lit(False)), found)


def bucket(match: Column, gt: Column, pred: Column) -> Column:
    return (F.when(match, "match").when(gt.isNotNull() & pred.isNull(), "gt_only")
            .when(gt.isNull() & pred.isNotNull(), "pred_only").otherwise("overlap_mismatch"))


def comparison_table(records: DataFrame, key: str, text: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per record, field and normalised claim value, with evidence on both sides.

    ``fields`` maps a field name to its (truth, prediction) list columns. The
    outer alignment of the two short lists is a map merge inside the row, so
    records are never shuffled, however many claims they hold. A record
    without any value for a field keeps one placeholder row.
    """
    base = records.withColumn("_sentences", keyed_sentences(F.col(text)))

    def keyed(values: Column) -> Column:
        items = F.coalesce(values, F.array().cast("array<string>"))
        entries = F.transform(items, lambda v: F.struct(ascii_key(v).alias("key"), v.alias("value")))
        return F.filter(entries, lambda e: e["key"] != "")

    def last(entries: Column, k: Column) -> Column:
        return F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]

    keyed_cols = {}
    for name, (gt, pred) in fields.items():
        keyed_cols |= {f"_g_{name}": keyed(F.col(gt)), f"_p_{name}": keyed(F.col(pred))}
    base = base.withColumns(keyed_cols)
    def claims(name: str) -> Column:
        g, p = F.col(f"_g_{name}"), F.col(f"_p_{name}")
        has = lambda entries, k: F.exists(entries, lambda e: e["key"] == k)
        keys = F.array_sort(F.array_union(F.transform(g, lambda e: e["key"]), F.transform(p, lambda e: e["key"])))
        claim = F.transform(keys, lambda k: F.struct(F.when(has(g, k), last(g, k)).alias("gt_value"),
                                                     F.when(has(p, k), last(p, k)).alias("pred_value")))
        none = F.struct(F.lit(None).cast("string").alias("gt_value"), F.lit(None).cast("string").alias("pred_value"))
        rows = let(claim, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(none)))
        return F.transform(rows, lambda r: F.struct(
            F.lit(name).alias("field"), r["gt_value"].alias("gt_value"), r["pred_value"].alias("pred_value"),
            ground(name, r["gt_value"], F.col("_sentences")).alias("gt"),
            ground(name, r["pred_value"], F.col("_sentences")).alias("pred")))

    out = base.select(key, F.explode(F.flatten(F.array(*[claims(name) for name in fields]))).alias("r"))
    g, p = F.col("r.gt_value"), F.col("r.pred_value")
    claimed = g.isNotNull() | p.isNotNull()
    match = F.when(claimed, g.isNotNull() & p.isNotNull())
    # A placeholder row has no claim on either side and so no outcome.
    return out.select(
        key, F.col("r.field").alias("field"), F.coalesce(g, p).alias("target_value"), match.alias("match"),
        g.alias("gt_value"), p.alias("pred_value"), F.col("r.gt.support_type").alias("gt_support_type"),
        F.col("r.gt.quote").alias("gt_quote"), F.col("r.pred.support_type").alias("pred_support_type"),
        F.col("r.pred.quote").alias("pred_quote"), bucket(F.coalesce(match, F.lit(False)), g, p).alias("bucket"))


def in_order(table: DataFrame, key: str) -> DataFrame:
    """The comparison table by record, field, bucket and claim, with a label of record and field; a distributed sort."""
    label = F.concat(F.col(key).cast("string"), F.lit(" · "), F.col("field"))
    return table.withColumn("record_field", label).orderBy(key, "field", "bucket", F.asc_nulls_last("target_value"))


def crosstab(table: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Zero-filled counts; NULL in ``row`` stays a group of its own."""
    return table.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).fillna(0, subset=values)
