"""Normalisation and validation queries over a messy sheet derived from ``customer``."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat.functions import coerce, text, vocab
from concordat.operators import evaluate as ev
from concordat.operators import normalize as nz
from concordat.plans.base import derived, plain, table

SHEET = """
SELECT c_custkey AS id,
  CASE c_custkey % 7 WHEN 0 THEN 'EBV Genetic Analyses (x), presence only' WHEN 1 THEN ' Abundance ' WHEN 2 THEN 'species richness,density records'
    WHEN 3 THEN 'N/A' WHEN 4 THEN 'Presence' WHEN 5 THEN 'presence-absence' ELSE c_mktsegment END AS data_type,
  CASE c_custkey % 6 WHEN 0 THEN 'site coordinates maps' WHEN 1 THEN 'Sample coordinates, geographic feature foo' WHEN 2 THEN 'administrative units'
    WHEN 3 THEN NULL WHEN 4 THEN 'id, ids , Site' ELSE c_mktsegment END AS geospatial_info_dataset,
  CASE c_custkey % 4 WHEN 0 THEN replace(CAST(c_acctbal AS STRING), '.', ',') WHEN 1 THEN CAST(c_acctbal AS STRING)
    WHEN 2 THEN '1,234,567' ELSE 'unknown' END AS spatial_range_km2,
  CASE c_custkey % 3 WHEN 0 THEN '1999.0' WHEN 1 THEN CAST(2001 + c_nationkey AS STRING) ELSE 'nan' END AS temporal_range,
  CASE c_custkey % 3 WHEN 0 THEN '1999.7' WHEN 1 THEN CAST(1980 + c_nationkey AS STRING) ELSE 'circa' END AS temp_range_i,
  CASE c_custkey % 2 WHEN 0 THEN CAST(2000 + c_nationkey AS STRING) ELSE '' END AS temp_range_f,
  c_name || '; ' || lower(c_mktsegment) || ' , ,caribou' AS species,
  CASE c_custkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN ' No ' WHEN 2 THEN '1' WHEN 3 THEN 'maybe' ELSE NULL END AS time_series,
  CASE c_nationkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'Maybe' END AS valid_yn,
  CASE c_custkey % 4 WHEN 0 THEN 'Non biological' WHEN 1 THEN 'gut microbiota of mice' WHEN 2 THEN 'experiment' ELSE c_mktsegment END AS reason_not_valid
FROM {customer}"""

# Oracle: the same cleanup written independently in SQL.
_CELL = """CASE WHEN lower(trim({c})) IN ('not given', 'not_given', 'na', 'n/a', 'nan', 'none', '') THEN NULL
  WHEN contains(trim({c}), ',') AND regexp_full_match(trim({c}), '[0-9,.\\-]+') THEN replace(trim({c}), ',', '.') ELSE trim({c}) END"""
_NUM = "CASE WHEN regexp_full_match({c}, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST({c} AS DOUBLE) END"


def _map_sql(table_: dict[str, str], key: str, default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items())
    return f"CASE {key} {whens} ELSE {default} END"


_DT_KEY = "trim(replace(replace(trim(string_split(trim(replace(trim(lower(x)), 'ebv', '')), '(')[1]), 'analyses', 'analysis'), 'records', ''))"
_DT_SNAKE = f"trim(replace(replace({_DT_KEY}, ' ', '_'), '-', '_'), '_')"
_DT = _map_sql(vocab.DATA_TYPE_SYNONYMS, _DT_KEY, _map_sql(vocab.DATA_TYPE_FALLBACK, _DT_SNAKE, _DT_SNAKE))
_GEO_KEY = "lower(trim(x))"
_GEO_SNAKE = f"trim(replace(replace({_GEO_KEY}, '-', '_'), ' ', '_'), '_')"
_GEO = _map_sql(vocab.GEO_SYNONYMS, _GEO_KEY, _map_sql(vocab.GEO_FALLBACK, _GEO_SNAKE, _GEO_SNAKE))
_GEO_VALUES = ", ".join(f"'{v}'" for v in vocab.GEO_TYPES)
# RE2 has no look-ahead: a phrase is matched with the blank that follows it.
_PHRASES = "(?i)((?:" + "|".join(vocab.GEO_PHRASES) + ") |[^ ]+ )"
_EMPTY_TO_NULL = "CASE WHEN len({l}) > 0 THEN {l} END"

_NORMAL = f"""
WITH sheet AS ({plain(SHEET)}),
cells AS (SELECT id, {', '.join(f"{_CELL.format(c=c)} AS {c}" for c in (
    'data_type', 'geospatial_info_dataset', 'spatial_range_km2', 'temporal_range', 'temp_range_i', 'temp_range_f', 'species',
    'time_series', 'valid_yn', 'reason_not_valid'))} FROM sheet),
parts AS (SELECT *, list_filter(list_transform(string_split(data_type, ','), lambda x: {_DT}), lambda x: x <> '') AS dt,
  list_filter(list_transform(string_split_regex(species, '[;,]'), lambda x: trim(x)), lambda x: x <> '') AS sp,
  list_filter(list_transform(string_split(geospatial_info_dataset, ','), lambda x: trim(x)), lambda x: x <> '') AS gp FROM cells),
geo AS (SELECT *, flatten(list_transform(gp, lambda item: CASE
    WHEN list_transform([item], lambda x: {_GEO})[1] NOT IN ({_GEO_VALUES}) AND contains(item, ' ')
    THEN list_transform(regexp_extract_all(regexp_replace(item, '\\s+', ' ', 'g') || ' ', '{_PHRASES}', 1), lambda y: list_transform([trim(y)], lambda x: {_GEO})[1])
    ELSE list_transform([item], lambda x: {_GEO}) END)) AS gl FROM parts),
typed AS (SELECT id, {_EMPTY_TO_NULL.format(l='dt')} AS data_type,
  list_filter(gl, lambda x: x <> '') AS g0,
  {_NUM.format(c="replace(replace(spatial_range_km2, ',', '.'), ' ', '')")} AS spatial_range_km2, temporal_range,
  CAST(trunc({_NUM.format(c='temp_range_i')}) AS INT) AS temp_range_i, CAST(trunc({_NUM.format(c='temp_range_f')}) AS INT) AS temp_range_f,
  {_EMPTY_TO_NULL.format(l='sp')} AS species,
  CASE WHEN lower(time_series) IN ('yes', 'true', '1') THEN true WHEN lower(time_series) IN ('no', 'false', '0') THEN false END AS time_series,
  valid_yn, CASE WHEN lower(reason_not_valid) = 'non biological' THEN 'biodiversity-unrelated' WHEN lower(reason_not_valid) = 'experiment' THEN 'non-field experiment'
    WHEN lower(reason_not_valid) IN ('micorbial community', 'microbial communities') OR starts_with(lower(reason_not_valid), 'gut microbiota') THEN 'microbial community'
    ELSE reason_not_valid END AS reason_not_valid FROM geo),
normal AS (SELECT * EXCLUDE (g0), CASE WHEN len(g0) > 0 THEN list_filter(g0, lambda x, i: list_position(g0, x) = i) END AS geospatial_info_dataset FROM typed)"""


def _sheet(spark, sf):
    return derived(spark, sf, SHEET)


def _flat(df):
    lists = [n for n, k in df.dtypes if k.startswith("array")]
    return df.withColumns({n: F.array_join(n, "|") for n in lists})


def normalize_features(spark, sf):
    return _flat(nz.normalize_features(_sheet(spark, sf)))


def validate_quarantine(spark, sf):
    """One row per error, spreadsheet contract."""
    return nz.validate(_sheet(spark, sf), "id", coerce_cells=True).errors


def validate_valid_rows(spark, sf):
    valid, _ = nz.validate_and_coerce(_sheet(spark, sf), "id")
    return _flat(valid)


def validate_first_failure(spark, sf):
    """Strict mode: only rows up to the first bad one are reported."""
    report = nz.validate(_sheet(spark, sf), "id", coerce_cells=True, strict=True)
    seen = report.valid.select("id", F.lit(False).alias("bad")).unionByName(report.invalid.select("id", F.lit(True).alias("bad")))
    return seen.agg(F.count_if(~F.col("bad")).alias("n_valid"), F.count_if("bad").alias("n_invalid"),
                    F.min(F.when(F.col("bad"), F.col("id"))).alias("first_bad"))


def validate_strict_types(spark, sf):
    """Extraction contract: no coercion, texts in typed columns are errors. Counts per field and kind."""
    report = nz.validate(_sheet(spark, sf), "id", coerce_cells=False)
    return report.errors.groupBy("field", "error_type").agg(F.count(F.lit(1)).alias("n"))


def validation_summary(spark, sf):
    return nz.validation_summary(nz.validate(_sheet(spark, sf), "id", coerce_cells=True))


def vocabulary_dimensions(spark, sf):
    """Share of rows of each normalised data type that is a known vocabulary entry."""
    rows = nz.normalize_features(_sheet(spark, sf)).select(F.explode("data_type").alias("label"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("label").isin(*vocab.DATA_TYPES)).alias("known"))


def exploratory_labels(spark, sf):
    labels = _sheet(spark, sf).select(F.explode(vocab.exploratory_data_types("data_type")).alias("label"))
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


LITERALS = """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '[''' || p_name || ''', '' x '', '''']' WHEN 1 THEN '  ' WHEN 2 THEN p_name
  WHEN 3 THEN '["' || p_brand || '", "' || p_type || '"]' ELSE '[broken' END AS cell FROM {part}"""


def list_literals(spark, sf):
    """Cells as lists: for grounding (never NULL) and for list columns of a sheet."""
    df = derived(spark, sf, LITERALS)
    return df.select("p_partkey", F.array_join(coerce.atomic_list("cell"), "|").alias("atoms"),
                     F.array_join(coerce.list_cell("cell"), "|").alias("items"))


def populated_cells(spark, sf):
    df = _sheet(spark, sf)
    return df.agg(*[F.count_if(text.is_populated(c, "string")).alias(c) for c in df.columns if c != "id"])


def text_profiles(spark, sf):
    """Length class, comparison form and ASCII key of every document."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", text.length_class("text").alias("length_class"),
                       F.sha2(text.normalize_string("text"), 256).alias("normal_sha"),
                       F.sha2(text.ascii_key("text"), 256).alias("key_sha"), F.sha2("text", 256).alias("text_sha"))


def dedup_first_per_source(spark, sf):
    """Keep-first and keep-last rows per key on an explicit ordinal."""
    docs = table(spark, sf, "documents").select("source", "doc_id", "lang")
    first = ev.keep_first(docs, "source", "doc_id").select("source", F.col("doc_id").alias("first_id"))
    last = ev.keep_last(docs, "source", "doc_id").select("source", F.col("doc_id").alias("last_id"), "lang")
    return first.join(last, "source")


_DT_LIST = "'" + "', '".join(vocab.DATA_TYPES) + "'"
_GEO_MSG = nz._listing(vocab.GEO_TYPES).replace("'", "''")
_DT_MSG = nz._listing(vocab.DATA_TYPES).replace("'", "''")
_YN_MSG = nz._listing(vocab.VALIDATION_STATUS).replace("'", "''")


def _suggest_sql(raw: str, valid: tuple[str, ...]) -> str:
    key = f"replace(replace(trim(lower({raw})), '-', '_'), ' ', '_')"
    equal = " ".join(f"WHEN {key} = '{v.replace('-', '_')}' THEN 'Use ''{v}'''" for v in valid)
    near = " ".join(f"WHEN contains('{v}', {key}) OR contains({key}, '{v}') THEN 'Consider ''{v}'''" for v in valid)
    return f"CASE {equal} {near} ELSE 'Valid values: {', '.join(valid[:5])}...' END"


_ERRORS = _NORMAL + f""",
errors AS (
  SELECT n.id AS row_id, 'data_type.' || (i - 1) AS field, s.data_type AS raw_value, 'data_error' AS error_type, '{_DT_MSG}' AS message,
    {_suggest_sql('s.data_type', vocab.DATA_TYPES)} AS suggested_fix
  FROM normal n JOIN sheet s ON n.id = s.id, range(1, len(n.data_type) + 1) r(i) WHERE n.data_type[i] NOT IN ({_DT_LIST})
  UNION ALL
  SELECT n.id, 'geospatial_info_dataset.' || (i - 1), s.geospatial_info_dataset, 'data_error', '{_GEO_MSG}', {_suggest_sql('s.geospatial_info_dataset', vocab.GEO_TYPES)}
  FROM normal n JOIN sheet s ON n.id = s.id, range(1, len(n.geospatial_info_dataset) + 1) r(i) WHERE n.geospatial_info_dataset[i] NOT IN ({_GEO_VALUES})
  UNION ALL
  SELECT n.id, 'spatial_range_km2', s.spatial_range_km2, 'data_error', 'Input should be greater than or equal to 0', ''
  FROM normal n JOIN sheet s ON n.id = s.id WHERE n.spatial_range_km2 < 0
  UNION ALL
  SELECT n.id, 'valid_yn', s.valid_yn, 'data_error', '{_YN_MSG}', '' FROM normal n JOIN sheet s ON n.id = s.id
  WHERE n.valid_yn NOT IN ('yes', 'no'))"""
_FLAT_COLS = """id, array_to_string(data_type, '|') AS data_type, array_to_string(geospatial_info_dataset, '|') AS geospatial_info_dataset,
  spatial_range_km2, temporal_range, temp_range_i, temp_range_f, array_to_string(species, '|') AS species, time_series, valid_yn, reason_not_valid"""

QUERIES = {f.__name__: f for f in (
    normalize_features, validate_quarantine, validate_valid_rows, validate_first_failure, validate_strict_types,
    validation_summary, vocabulary_dimensions, exploratory_labels, list_literals, populated_cells, text_profiles,
    dedup_first_per_source)}

_KEY_SQL = """trim(regexp_replace(lower(strip_accents(replace(trim(regexp_replace(regexp_replace({t}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), 'ß', ''))), '[^a-z0-9]+', ' ', 'g'))"""

ORACLE = {
    "normalize_features": _NORMAL + f" SELECT {_FLAT_COLS} FROM normal",
    "validate_quarantine": _ERRORS + " SELECT row_id, field, raw_value, error_type, message, suggested_fix FROM errors",
    "validate_valid_rows": _ERRORS + f" SELECT {_FLAT_COLS} FROM normal WHERE id NOT IN (SELECT row_id FROM errors)",
    "validate_first_failure": _ERRORS + """ SELECT count(*) FILTER (n.id < b.f) AS n_valid, count(*) FILTER (n.id = b.f) AS n_invalid, min(b.f) AS first_bad
      FROM normal n, (SELECT min(row_id) AS f FROM errors) b""",
    "validate_strict_types": f"""WITH sheet AS ({plain(SHEET)}), e AS (
      SELECT 'data_type' AS field, 'schema_error' AS error_type FROM sheet WHERE data_type IS NOT NULL
      UNION ALL SELECT 'geospatial_info_dataset', 'schema_error' FROM sheet WHERE geospatial_info_dataset IS NOT NULL
      UNION ALL SELECT 'species', 'schema_error' FROM sheet WHERE species IS NOT NULL
      UNION ALL SELECT 'spatial_range_km2', 'data_error' FROM sheet WHERE TRY_CAST(spatial_range_km2 AS DOUBLE) IS NULL OR TRY_CAST(spatial_range_km2 AS DOUBLE) < 0
      UNION ALL SELECT 'temp_range_i', 'data_error' FROM sheet WHERE NOT regexp_full_match(temp_range_i, '[0-9]+')
      UNION ALL SELECT 'temp_range_f', 'data_error' FROM sheet WHERE NOT regexp_full_match(temp_range_f, '[0-9]+')
      UNION ALL SELECT 'time_series', 'data_error' FROM sheet WHERE time_series = 'maybe'
      UNION ALL SELECT 'valid_yn', 'data_error' FROM sheet WHERE valid_yn NOT IN ('yes', 'no'))
      SELECT field, error_type, count(*) AS n FROM e GROUP BY ALL""",
    "validation_summary": _ERRORS + """ SELECT 'rows' AS section, 'valid' AS name, count(*) AS n FROM normal WHERE id NOT IN (SELECT row_id FROM errors)
      UNION ALL SELECT 'rows', 'invalid', count(DISTINCT row_id) FROM errors
      UNION ALL SELECT 'error_type', error_type, count(*) FROM errors GROUP BY error_type
      UNION ALL SELECT 'field', field, count(*) FROM errors GROUP BY field""",
    "vocabulary_dimensions": _NORMAL + f""", l AS (SELECT unnest(data_type) AS label FROM normal)
      SELECT label, count(*) AS n, bool_and(label IN ({_DT_LIST})) AS known FROM l GROUP BY label""",
    "exploratory_labels": f"""WITH sheet AS ({plain(SHEET)}), l AS (SELECT id, unnest(list_distinct(list_transform(string_split(data_type, ','), lambda x:
      replace(replace(replace(trim(string_split(replace(lower(x), 'ebv', ''), '(')[1]), '-', ' '), 'analyses', 'analysis'), 'presence only', 'presence')))) AS label FROM sheet)
      SELECT label, count(*) AS n FROM l GROUP BY label""",
    "list_literals": f"""WITH c AS ({plain(LITERALS)}) SELECT c.p_partkey, CASE c.p_partkey % 5 WHEN 0 THEN p_name || '|x' WHEN 1 THEN '' WHEN 2 THEN p_name
      WHEN 3 THEN p_brand || '|' || p_type ELSE '[broken' END AS atoms,
      CASE c.p_partkey % 5 WHEN 0 THEN p_name || '| x |' WHEN 1 THEN NULL WHEN 2 THEN p_name WHEN 3 THEN p_brand || '|' || p_type ELSE '[broken' END AS items
      FROM c JOIN part p ON c.p_partkey = p.p_partkey""",
    "populated_cells": f"""WITH sheet AS ({plain(SHEET)}) SELECT {', '.join(f"count(*) FILTER (trim({c}) <> '') AS {c}" for c in (
        'data_type', 'geospatial_info_dataset', 'spatial_range_km2', 'temporal_range', 'temp_range_i', 'temp_range_f', 'species',
        'time_series', 'valid_yn', 'reason_not_valid'))} FROM sheet""",
    "text_profiles": f"""SELECT doc_id, CASE WHEN length(text) > 10000 THEN 'article' WHEN length(text) > 2000 THEN 'extended_abstract' ELSE 'abstract' END AS length_class,
      sha256(replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss')) AS normal_sha,
      sha256({_KEY_SQL.format(t="replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&nbsp;', ' ')")}) AS key_sha,
      sha256(text) AS text_sha FROM documents""",
    "dedup_first_per_source": """SELECT source, min(doc_id) AS first_id, max(doc_id) AS last_id, arg_max(lang, doc_id) AS lang FROM documents GROUP BY source""",
}
