"""Controlled vocabularies and the cleanup that maps free text onto them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat.functions.arrays import null_if_empty
from concordat.functions.text import as_col, let, strip, words

# ---- Fixed values: vocabularies and synonym tables -------------------------

DATA_TYPES = ("abundance", "presence-absence", "presence-only", "density", "distribution", "traits",
              "ecosystem_function", "ecosystem_structure", "genetic_analysis", "time_series",
              "species_richness", "other", "unknown")

GEO_TYPES = ("sample", "site", "range", "distribution", "geographic_features", "administrative_units",
             "maps", "site_ids", "unknown")

VALIDATION_STATUS = ("yes", "no")

INVALID_REASONS = ("location", "non-relevant information", "non-field experiment", "not in the field",
                   "biodiversity-unrelated", "microbial community", "other")

FEATURE_LOCATIONS = ("abstract", "repository text", "article text", "dataset", "repository", "unknown")

DATA_SOURCES = ("dryad", "zenodo", "semantic_scholar", "referenced")

DATA_TYPE_SYNONYMS = {
    "abundance": "abundance",
    "presence-absence": "presence-absence",
    "presence only": "presence-only",
    "presence-only": "presence-only",
    "density": "density",
    "distribution": "distribution",
    "traits": "traits",
    "ecosystem function": "ecosystem_function",
    "ecosystem_function": "ecosystem_function",
    "ecosystem structure": "ecosystem_structure",
    "ecosystem_structure": "ecosystem_structure",
    "genetic analysis": "genetic_analysis",
    "genetic_analysis": "genetic_analysis",
    "ebv genetic analysis": "genetic_analysis",
    "time series": "time_series",
    "time_series": "time_series",
    "species richness": "species_richness",
    "species_richness": "species_richness",
    "other": "other",
    "unknown": "unknown",
}

# Reached only by values missing from the table above, after blanks and
# hyphens became underscores.
DATA_TYPE_FALLBACK = {
    "presence": "presence-only",
    "presence_only": "presence-only",
    "presence_absence": "presence-absence",
}

GEO_SYNONYMS = {
    "sample": "sample",
    "sample coordinates": "sample",
    "site": "site",
    "site coordinates": "site",
    "range": "range",
    "range coordinates": "range",
    "distribution": "distribution",
    "species distribution": "distribution",
    "geographic features": "geographic_features",
    "geographic_features": "geographic_features",
    "administrative units": "administrative_units",
    "administrative_units": "administrative_units",
    "maps": "maps",
    "site ids": "site_ids",
    "site_ids": "site_ids",
    "unknown": "unknown",
}

GEO_FALLBACK = {
    "sample_coordinates": "sample",
    "site_coordinates": "site",
    "sites_ids": "site_ids",
    "site_id": "site_ids",
    "ids": "site_ids",
    "id": "site_ids",
    "range_coordinates": "range",
    "geographic_feature": "geographic_features",
    "administrative_unit": "administrative_units",
    "distribution_model": "distribution",
    "map": "maps",
}

# Two-word phrases that stay together when an unknown value is taken apart.
GEO_PHRASES = ("site coordinates", "sample coordinates", "range coordinates", "geographic feature",
               "geographic features", "administrative unit", "administrative units", "site ids",
               "distribution model")

REASON_SYNONYMS = {
    "non biological": "biodiversity-unrelated",
    "experiment": "non-field experiment",
    "micorbial community": "microbial community",
    "microbial communities": "microbial community",
}
REASON_PREFIX = ("gut microbiota", "microbial community")

# ---- Expressions -----------------------------------------------------------


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of ``key`` in a small constant table, NULL when absent."""
    text = "\x02".join(f"{k}\x03{v}" for k, v in table.items())
    return F.try_element_at(F.str_to_map(F.lit(text), F.lit("\x02"), F.lit("\x03")), key)


def data_type_value(value: Column | str) -> Column:
    """One data-type label in its canonical spelling (unknown ones in snake case)."""
    v = F.replace(strip(F.lower(as_col(value))), F.lit("ebv"), F.lit(""))
    v = strip(F.substring_index(strip(v), "(", 1))
    v = F.replace(v, F.lit("analyses"), F.lit("analysis"))
    v = strip(F.replace(v, F.lit("records"), F.lit("")))
    return let(v, lambda x: F.coalesce(lookup(DATA_TYPE_SYNONYMS, x), let(
        F.btrim(F.translate(x, " -", "__"), F.lit("_")), lambda y: F.coalesce(lookup(DATA_TYPE_FALLBACK, y), y))))


def geo_value(value: Column | str) -> Column:
    return let(strip(F.lower(as_col(value))), lambda x: F.coalesce(lookup(GEO_SYNONYMS, x), let(
        F.btrim(F.translate(x, "- ", "__"), F.lit("_")), lambda y: F.coalesce(lookup(GEO_FALLBACK, y), y))))


def reason_value(value: Column | str) -> Column:
    v = strip(as_col(value))
    prefix, target = REASON_PREFIX
    return (F.when(F.lower(v).startswith(prefix), target)
            .otherwise(F.coalesce(lookup(REASON_SYNONYMS, F.lower(v)), v)))


def as_items(value: Column, data_type: str) -> Column:
    """A list column as is; a text column as a one-item list."""
    return value if data_type.startswith("array") else F.when(value.isNotNull(), F.array(value))


def _parts(items: Column, separators: str) -> Column:
    pieces = F.flatten(F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: F.split(x, separators)))
    return F.filter(F.transform(pieces, strip), lambda x: x != "")


def species_list(value: Column, data_type: str = "string") -> Column:
    return null_if_empty(_parts(as_items(value, data_type), "[;,]"))


def data_type_list(value: Column, data_type: str = "string") -> Column:
    mapped = F.transform(_parts(as_items(value, data_type), ","), data_type_value)
    return null_if_empty(F.filter(mapped, lambda x: x != ""))


def geo_list(value: Column, data_type: str = "string") -> Column:
    """Geospatial labels; unknown multi-word text falls apart into known
    two-word phrases and single words, left to right."""
    phrase = r"(?i)((?:" + "|".join(GEO_PHRASES) + r")(?= |$)|[^ ]+)"

    def expand(item: Column) -> Column:
        pieces = F.regexp_extract_all(F.array_join(words(item), " "), F.lit(phrase), 1)
        return let(geo_value(item), lambda whole: F.when(
            ~whole.isin(*GEO_TYPES) & item.contains(" "), F.transform(pieces, geo_value)).otherwise(F.array(whole)))

    labels = F.flatten(F.transform(_parts(as_items(value, data_type), ","), expand))
    return null_if_empty(F.array_distinct(F.filter(labels, lambda x: x != "")))


def suggest_value(value: Column | str, valid: tuple[str, ...]) -> Column:
    """Closest vocabulary entry for a rejected value: equal, then containing, then a listing."""
    choices = F.array(*[F.lit(x) for x in valid])

    def suggest(key: Column) -> Column:
        equal = F.filter(choices, lambda x: key == F.translate(F.lower(x), "-", "_"))
        near = F.filter(choices, lambda x: F.contains(F.lower(x), key) | F.contains(key, F.lower(x)))
        return F.when(key.isNotNull(), F.coalesce(
            F.concat(F.lit("Use '"), F.get(equal, F.lit(0)), F.lit("'")),
            F.concat(F.lit("Consider '"), F.get(near, F.lit(0)), F.lit("'")),
            F.lit(f"Valid values: {', '.join(valid[:5])}...")))

    return let(F.translate(strip(F.lower(as_col(value))), "- ", "__"), suggest)


def exploratory_data_types(value: Column | str) -> Column:
    """Older, looser cleanup used while browsing raw labels: distinct, sorted."""
    def clean(part: Column) -> Column:
        v = F.replace(F.lower(part), F.lit("ebv"), F.lit(""))
        v = strip(F.substring_index(v, "(", 1))
        v = F.replace(F.translate(v, "-", " "), F.lit("analyses"), F.lit("analysis"))
        return F.replace(v, F.lit("presence only"), F.lit("presence"))

    parts = F.transform(F.split(as_col(value), ","), clean)
    return F.coalesce(F.array_sort(F.array_distinct(parts)), F.array().cast("array<string>"))
