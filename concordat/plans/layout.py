"""Queries on rows by their place, seeded samples, and extraction schemas with evidence."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from concordat.operators import evidence as evd
from concordat.operators import places, sampling
from concordat.plans.base import derived, plain, table

# ---- Places ----------------------------------------------------------------


def reattach_by_place(spark, sf):
    """Valid rows lose columns that are no features; they come back by the rows' places in the sheet's file."""
    path = f"{sf}/orders.parquet"
    sheet = places.scan(spark, path, ["o_orderstatus", "o_totalprice"])
    valid = sheet.where("o_orderstatus <> 'P'").select(places.PLACE, F.round("o_totalprice").alias("price"))
    whole = places.scan(spark, path, ["o_orderkey", "o_orderpriority"])
    return places.reattach(valid, whole, ["o_orderkey", "o_orderpriority"]).withColumnRenamed(places.PLACE, "place")


def side_by_side_files(spark, sf):
    """Two tables without a common key, row beside row."""
    left = places.scan(spark, f"{sf}/customer.parquet", ["c_custkey", "c_name"])
    right = places.scan(spark, f"{sf}/part.parquet", ["p_partkey", "p_brand"])
    return places.side_by_side(left, right).withColumnRenamed(places.PLACE, "place")


# ---- Samples ---------------------------------------------------------------

SAMPLE_SEED, SAMPLE_ROWS, SAMPLE_PER_KEY = 38, 25, 3


def sample_rows(spark, sf):
    """A seeded sample of exactly so many rows that pass a filter."""
    found = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderpriority")
    return sampling.sample(found, SAMPLE_ROWS, SAMPLE_SEED, columns=["o_orderkey"])


def sample_per_key(spark, sf):
    found = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return sampling.sample(found, SAMPLE_PER_KEY, SAMPLE_SEED, by=["l_returnflag", "l_linestatus"], columns=["l_orderkey", "l_linenumber"])


def _rank_sql(*columns: str) -> str:
    texts = " || chr(31) || ".join(f"'=' || CAST({c} AS VARCHAR)" for c in columns)
    return f"substr(md5('{SAMPLE_SEED}' || chr(31) || {texts}), 1, 15)"


# ---- Evidence --------------------------------------------------------------

SITE = "site string, years array<int>"
EXTRACTION = f"species array<string>, temp_range_i int, place struct<{SITE}>, surveys array<struct<{SITE}>>"
# A record for every order: evidence on the record, its place and its surveys, with confidences inside and outside 0 to 5.
RECORDS = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 = 0 THEN '{{"species": [' WHEN o_orderkey % 19 = 0 THEN NULL ELSE
  '{{"species": ["' || o_orderpriority || '"], "temp_range_i": ' || (o_custkey % 50) || ', "place": {{"site": "' || o_orderstatus || '", "years": [1, 2], "evidence": [' ||
  CASE WHEN o_orderkey % 3 = 0 THEN '{{"field_name": "site", "confidence": ' || (o_orderkey % 8 - 1) || '}}' ELSE '' END || ']}}, "surveys": [{{"site": null}}, {{"site": "b", "evidence": [{{"field_name": ' || CASE WHEN o_orderkey % 11 = 0 THEN 'null' ELSE '"site"' END || ', "confidence": 3}}, {{"field_name": "years", "value": "[1]", "confidence": ' ||
  (o_orderkey % 7) || '}}]}}], "evidence": [{{"field_name": "' || CASE WHEN o_orderkey % 5 = 0 THEN 'colour' ELSE 'species' END || '", "quote": "q' || o_orderkey || '", "confidence": ' ||
  CASE WHEN o_orderkey % 4 = 0 THEN 'null' ELSE CAST(o_orderkey % 9 - 2 AS VARCHAR(9)) END || '}}]}}' END AS reply FROM {orders}"""


def _parsed(spark, sf):
    return evd.parse(derived(spark, sf, RECORDS), "reply", StructType.fromDDL(EXTRACTION), deep=True)


def evidence_quarantine(spark, sf):
    """One row for each error of the evidence, at whatever depth."""
    return evd.quarantine(_parsed(spark, sf), "id")[1]


def evidence_accepted(spark, sf):
    """Accepted records: the highest confidence at each depth."""
    good, _ = evd.quarantine(_parsed(spark, sf), "id")
    most = lambda c: F.array_max(F.transform(c, lambda e: e["confidence"].cast("bigint")))
    return good.select("id", F.col("output.species")[0].alias("species"), most(F.col("output.evidence")).alias("record"),
                       most(F.col("output.place.evidence")).alias("place"),
                       F.array_max(F.transform("output.surveys", lambda s: most(s["evidence"]))).alias("surveys"))


QUERIES = {f.__name__: f for f in (reattach_by_place, side_by_side_files, sample_rows, sample_per_key, evidence_quarantine,
                                   evidence_accepted)}

_CHECKED = f"""WITH r AS ({plain(RECORDS)}), p AS (SELECT id, reply, o_orderkey % 17 = 0 AS broken FROM r JOIN orders ON id = o_orderkey),
 pieces AS (SELECT id, 'evidence.0' AS loc, CASE WHEN id % 5 = 0 THEN 'colour' ELSE 'species' END AS name, CASE WHEN id % 4 <> 0 THEN id % 9 - 2 END AS confidence FROM p WHERE id % 17 <> 0 AND id % 19 <> 0
   UNION ALL SELECT id, 'place.evidence.0', 'site', id % 8 - 1 FROM p WHERE id % 17 <> 0 AND id % 19 <> 0 AND id % 3 = 0
   UNION ALL SELECT id, 'surveys.1.evidence.0', CASE WHEN id % 11 <> 0 THEN 'site' END, 3 FROM p WHERE id % 17 <> 0 AND id % 19 <> 0
   UNION ALL SELECT id, 'surveys.1.evidence.1', 'years', id % 7 FROM p WHERE id % 17 <> 0 AND id % 19 <> 0),
 errors AS (SELECT id AS row_id, 'output' AS field, reply AS raw_value, 'data_error' AS error_type, 'Input should be a valid JSON object' AS message, '' AS suggested_fix FROM p WHERE broken
   UNION ALL SELECT id, loc || '.field_name', NULL, 'data_error', 'Field required', '' FROM pieces WHERE name IS NULL
   UNION ALL SELECT id, loc || '.confidence', CAST(confidence AS VARCHAR), 'data_error', 'Input should be greater than or equal to 0', '0' FROM pieces WHERE confidence < 0
   UNION ALL SELECT id, loc || '.confidence', CAST(confidence AS VARCHAR), 'data_error', 'Input should be less than or equal to 5', '5' FROM pieces WHERE confidence > 5)"""

ORACLE = {
    "reattach_by_place": """SELECT place, price, o_orderkey, o_orderpriority FROM (SELECT row_number() OVER () - 1 AS place, round(o_totalprice) AS price,
      o_orderkey, o_orderpriority, o_orderstatus FROM orders) WHERE o_orderstatus <> 'P'""",
    "side_by_side_files": """SELECT coalesce(a.place, b.place) AS place, c_custkey, c_name, p_partkey, p_brand FROM
      (SELECT row_number() OVER () - 1 AS place, c_custkey, c_name FROM customer) a FULL JOIN
      (SELECT row_number() OVER () - 1 AS place, p_partkey, p_brand FROM part) b ON a.place = b.place""",
    "sample_rows": f"""SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' ORDER BY {_rank_sql('o_orderkey')} LIMIT {SAMPLE_ROWS}""",
    "sample_per_key": f"""SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY {_rank_sql('l_orderkey', 'l_linenumber')}) <= {SAMPLE_PER_KEY}""",
    "evidence_quarantine": _CHECKED + " SELECT row_id, field, raw_value, error_type, message, suggested_fix FROM errors",
    "evidence_accepted": _CHECKED + """ SELECT p.id, CASE WHEN reply IS NOT NULL THEN o_orderpriority END AS species,
      max(confidence) FILTER (loc = 'evidence.0') AS record, max(confidence) FILTER (loc = 'place.evidence.0') AS place, max(confidence) FILTER (loc LIKE 'surveys%') AS surveys
      FROM p JOIN orders ON p.id = o_orderkey LEFT JOIN pieces ON pieces.id = p.id WHERE p.id NOT IN (SELECT row_id FROM errors) GROUP BY ALL""",
}
