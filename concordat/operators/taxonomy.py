"""Taxon enrichment: staged backbone resolution and derived comparison fields."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.functions import taxa
from concordat.functions.arrays import null_if_empty
from concordat.operators.evaluate import Aligned, EvalConfig, FieldStrategy, align
from concordat.session import broadcast_if_small

# Fields of the taxonomy evaluation and how they compare.
TAXONOMY_STRATEGIES = {
    "species": FieldStrategy("enhanced_species", 70),
    "species_richness_counts": FieldStrategy(),
    "species_richness_group_keys": FieldStrategy(),
    "taxon_broad_group_labels": FieldStrategy(),
    "gbif_keys": FieldStrategy(),
    "species_stripped_richness": FieldStrategy("enhanced_species", 70),
    "gbif_key_stripped_richness": FieldStrategy(),
}
# Views that only compare where something is left: of the truth, or of both sides.
GATED = {"species_stripped_richness": "t", "gbif_key_stripped_richness": "tp"}
BACKBONE_COLUMNS = ("name", "usage_key", "scientific_name", "canonical_name", "rank", "confidence", "match_type",
                    "kingdom", "phylum", "class", "order", "family", "genus")


def acceptable_matches(backbone: DataFrame, *, confidence_threshold: int = 80, accept_higherrank: bool = True,
                       strict: bool = False) -> DataFrame:
    """Backbone rows good enough to be used. ``backbone`` is the staged lookup
    table: one row per queried name, in ``BACKBONE_COLUMNS``."""
    usable = (F.col("match_type") != "NONE") & F.col("usage_key").isNotNull() & (F.col("usage_key") != 0)
    usable &= F.col("confidence") >= confidence_threshold
    if strict:
        usable &= F.col("match_type") == "EXACT"
    if not accept_higherrank:
        usable &= F.col("match_type") != "HIGHERRANK"
    return backbone.filter(usable)


def resolve_taxa(records: DataFrame, key: str, backbone: DataFrame, *, species: str = "species",
                 confidence_threshold: int = 80, accept_higherrank: bool = True, keep: list[str] | None = None) -> DataFrame:
    """One row per listed name with its first acceptable backbone match.

    Candidates are the scientific name, then the vernacular, then (only when
    both are missing) the original text. Distinct candidate names are joined
    once to the backbone, so a name used in a third of all records is looked up
    by one row; the way back is a join AQE can split, and the choice among a
    name's candidates is a ``min_by`` with partial aggregation.
    """
    matches = acceptable_matches(backbone, confidence_threshold=confidence_threshold,
                                 accept_higherrank=accept_higherrank)
    keep = keep or []
    # Exploded as an expression: Spark filters empty columns early, and would make the whole list once more for that.
    items = F.transform(species, lambda x: x)
    listed = records.select(key, *keep, F.posexplode(items).alias("pos", "original")).filter("original IS NOT NULL")
    distinct = listed.select("original").distinct().withColumn("parsed", taxa.parse_taxon("original"))
    p = F.col("parsed")
    sci, ver = F.nullif(p["scientific"], F.lit("")), F.nullif(p["vernacular"], F.lit(""))
    named = F.array_compact(F.array(sci, ver))
    candidates = F.when(F.size(named) > 0, named).when(p["original"] != "", F.array(p["original"]))
    tried = distinct.select("original", "parsed", F.posexplode_outer(candidates).alias("try", "candidate"))
    tried = tried.withColumn("candidate", F.btrim("candidate"))
    hits = tried.join(broadcast_if_small(matches.select(*BACKBONE_COLUMNS)), F.col("candidate") == F.col("name"), "left")
    taxon = F.struct(*[F.col(c) for c in BACKBONE_COLUMNS[1:]])
    first = F.when(F.col("usage_key").isNotNull(), F.col("try"))
    resolved = hits.groupBy("original").agg(
        F.first("parsed").alias("parsed"), F.min_by(F.when(first.isNotNull(), taxon), first).alias("taxon"))
    return listed.join(resolved, "original", "left").select(key, *keep, "pos", "original", "parsed", "taxon")


def enrich(records: DataFrame, key: str, backbone: DataFrame | None = None, *, species: str = "species",
           confidence_threshold: int = 80, accept_higherrank: bool = True) -> DataFrame:
    """Add parsed names, richness mentions, counts, group keys, group labels, backbone keys, and the names left
    without numbered parts with their keys.

    Names and what is left of them are resolved in one pass. Columns already
    present are kept where they are not NULL.
    """
    given = set(records.columns)
    staged = records.withColumns({"_parsed": taxa.parsed_taxa(species), "_mentions": taxa.richness_mentions(species)})
    derived = {
        "parsed_species": F.col("_parsed"),
        "species_richness_mentions": F.col("_mentions"),
        "species_richness_counts": taxa.richness_counts(species, F.col("_mentions")),
        "species_richness_group_keys": taxa.richness_group_keys(F.col("_mentions")),
        "taxon_broad_group_labels": taxa.group_labels(F.col("_parsed"), F.col("_mentions")),
        "gbif_keys": F.lit(None).cast("array<bigint>"),
        "species_stripped_richness": taxa.stripped_names(species),
        "gbif_key_stripped_richness": F.lit(None).cast("array<bigint>"),
    }
    if backbone is not None:
        names = F.coalesce(F.col(species), F.array().cast("array<string>"))
        rest = F.coalesce(taxa.stripped_names(species), F.array().cast("array<string>"))
        both = records.select(key, F.size(names).alias("_own"), F.concat(names, rest).alias("_names"))
        resolved = resolve_taxa(both, key, backbone, species="_names", confidence_threshold=confidence_threshold,
                                accept_higherrank=accept_higherrank, keep=["_own"])
        own = F.col("pos") < F.col("_own")
        label = taxa.rank_group_label(F.col("taxon.family"), F.col("taxon.order"), F.col("taxon.class"),
                                      F.col("taxon.phylum"))
        per_record = resolved.filter("taxon IS NOT NULL").groupBy(key).agg(
            null_if_empty(F.array_sort(F.collect_set(F.when(own, F.col("taxon.usage_key"))))).alias("_keys"),
            null_if_empty(F.array_sort(F.collect_set(F.when(~own, F.col("taxon.usage_key"))))).alias("_rest_keys"),
            F.collect_set(F.when(own, label)).alias("_labels"))
        staged = staged.join(per_record, key, "left")
        own = F.coalesce(derived["taxon_broad_group_labels"], F.array().cast("array<string>"))
        labels = F.array_sort(F.array_union(own, F.coalesce("_labels", F.array().cast("array<string>"))))
        derived["taxon_broad_group_labels"] = F.when(F.size(labels) > 0, labels)
        derived["gbif_keys"] = F.col("_keys")
        derived["gbif_key_stripped_richness"] = F.col("_rest_keys")
    final = {name: F.coalesce(F.col(name), value) if name in given else value for name, value in derived.items()}
    return staged.withColumns(final).drop("_parsed", "_mentions", "_keys", "_rest_keys", "_labels")


def evaluate_taxonomy(truth: DataFrame, pred: DataFrame, key: str, backbone: DataFrame | None = None, *,
                      fields: list[str] | None = None, config: EvalConfig | None = None) -> Aligned:
    """Enrich both sides and compare the taxonomy fields.

    A gated view counts nothing where its side has nothing left, and never as
    an error.
    """
    names = fields or list(TAXONOMY_STRATEGIES)
    config = config or EvalConfig(field_strategies={n: s for n, s in TAXONOMY_STRATEGIES.items() if n in names})
    aligned = align(enrich(truth, key, backbone), enrich(pred, key, backbone), key, fields=names, config=config)
    wide = aligned.wide
    for name, sides in GATED.items():
        if name in aligned.fields:
            there = reduce(lambda a, b: a & b, [F.col(f"{s}_{name}").isNotNull() for s in sides])
            kind = wide.schema[f"c_{name}"].dataType
            nothing = F.struct(*[(F.lit(True) if f.name == "match" else F.lit(0)).cast(f.dataType).alias(f.name) for f in kind])
            wide = wide.withColumn(f"c_{name}", F.when(there, F.col(f"c_{name}")).otherwise(nothing))
    return replace(aligned, wide=wide)
