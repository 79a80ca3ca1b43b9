"""Fuzzy and taxon-name queries; names are derived from ``part`` and ``supplier``."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat.functions import taxa
from concordat.functions.similarity import indel_ratio_sql, name_parts
from concordat.operators import evaluate as ev
from concordat.operators import mismatch as mm
from concordat.operators import taxonomy as tx
from concordat.plans.base import derived, plain

# Names: "small ring" -> "Small ring" looks like a binomial.
NAMES = """
SELECT p_partkey, p_name, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS sci, p_brand, lower(p_type) AS ver, p_size,
  replace(replace(p_name, 'i', 'y'), 'e', 'a') AS typo FROM {part}"""


def _lists(spark, sf):
    n = derived(spark, sf, NAMES)
    truth = n.select("p_partkey", F.array("p_name", F.col("p_brand")).alias("species"))
    pred = n.select("p_partkey", F.array(F.upper("typo"), F.concat(F.lit(" "), F.col("p_brand")), F.col("ver")).alias("species"))
    return truth, pred


def eval_fuzzy_list(spark, sf):
    truth, pred = _lists(spark, sf)
    config = ev.EvalConfig(field_strategies={"species": ev.FieldStrategy("fuzzy", 80)})
    aligned = ev.align(truth, pred, "p_partkey", config=config)
    return aligned.wide.select("p_partkey", "c_species.*")


def eval_fuzzy_metrics(spark, sf):
    truth, pred = _lists(spark, sf)
    config = ev.EvalConfig(fuzzy_match_fields={"species": 70})
    return ev.field_metrics(ev.align(truth, pred, "p_partkey", config=config, matching="join"))


def eval_fuzzy_scalar(spark, sf):
    n = derived(spark, sf, NAMES)
    config = ev.EvalConfig(field_strategies={"name": ev.FieldStrategy("fuzzy", 85)})
    aligned = ev.align(n.select("p_partkey", F.col("p_name").alias("name")), n.select("p_partkey", F.col("typo").alias("name")),
                       "p_partkey", config=config)
    return aligned.wide.select("p_partkey", "c_name.*")


def indel_similarity(spark, sf):
    """The JVM-only form of the score on every distinct pair of names."""
    n = derived(spark, sf, NAMES).select("p_name", "typo").distinct()
    return n.select("p_name", "typo", F.round(indel_ratio_sql("p_name", "typo"), 6).alias("score"))


def _taxon_lists(spark, sf):
    n = derived(spark, sf, NAMES)
    truth = n.select("p_partkey", F.array("sci", F.concat("ver", F.lit(" ("), "p_brand", F.lit(")"))).alias("species"))
    pred = n.select("p_partkey", F.array(
        F.concat("ver", F.lit(" ("), "sci", F.lit(")")), F.concat("p_brand", F.lit(" of "), "typo"),
        F.concat("sci", F.lit(" ("), "ver", F.lit(")"))).alias("species"))
    return truth, pred


def eval_taxon_list(spark, sf):
    truth, pred = _taxon_lists(spark, sf)
    config = ev.EvalConfig(field_strategies={"species": ev.FieldStrategy("enhanced_species", 70)})
    aligned = ev.align(truth, pred, "p_partkey", config=config)
    return aligned.wide.select("p_partkey", "c_species.*")


def eval_taxon_list_join(spark, sf):
    """Each distinct pair of names is scored once, however many records it occurs in."""
    truth, pred = _taxon_lists(spark, sf)
    config = ev.EvalConfig(field_strategies={"species": ev.FieldStrategy("enhanced_species", 70)})
    aligned = ev.align(truth, pred, "p_partkey", config=config, matching="join")
    return aligned.wide.select("p_partkey", "c_species.*")


def taxon_name_parts(spark, sf):
    _, pred = _taxon_lists(spark, sf)
    rows = pred.select(F.explode("species").alias("name")).distinct()
    return rows.select("name", name_parts("name").alias("p")).select("name", "p.*")


# Raw taxon strings of many shapes, one per part.
RAW = """
SELECT p_partkey, CASE p_partkey % 10
  WHEN 0 THEN upper(substr(p_name, 1, 1)) || substr(p_name, 2)
  WHEN 1 THEN p_size || ' ' || p_name || 's species'
  WHEN 2 THEN lower(p_type) || ' ' || p_name || ' (' || upper(substr(p_name, 1, 1)) || substr(p_name, 2) || ')'
  WHEN 3 THEN upper(substr(p_name, 1, 1)) || substr(p_name, 2) || ' (' || lower(p_type) || ')'
  WHEN 4 THEN 'c.' || p_size || ' species of ' || p_name || ' and others'
  WHEN 5 THEN p_size || ' ' || lower(p_type) || ' mock species'
  WHEN 6 THEN 'beetles'
  WHEN 7 THEN 'about ' || p_size || ' the ' || p_name || ' (' || p_brand || ') taxa'
  WHEN 8 THEN p_name || '; ' || lower(p_type) || ' and ' || p_size || ' mice / ' || upper(p_name) || ', ' || p_name
  ELSE '  ' || p_brand || ' ' END AS raw FROM {part}"""
BY_SIZE = "SELECT p_size, CAST(p_partkey AS INT) AS ord, raw FROM ({raw_sql}) r JOIN {{part}} p USING (p_partkey)"


def species_parse(spark, sf):
    rows = derived(spark, sf, RAW)
    return rows.select("p_partkey", taxa.parse_taxon("raw").alias("t")).select("p_partkey", "t.*")


def richness_mentions(spark, sf):
    rows = derived(spark, sf, RAW)
    return rows.select("p_partkey", taxa.parse_richness("raw").alias("m")).select(
        "p_partkey", "m.count", "m.normalized_group", "m.approximate")


def _species_by_part(spark, sf):
    """Two-item species lists: the part's own string and a plain name."""
    return derived(spark, sf, RAW.replace("AS raw FROM", "AS raw, p_name FROM")).select(
        "p_partkey", F.array("raw", "p_name").alias("species"))


def richness_keys(spark, sf):
    df = _species_by_part(spark, sf).withColumn("m", taxa.richness_mentions("species"))
    return df.select("p_partkey", F.array_join(taxa.richness_counts("species", F.col("m")).cast("array<string>"), ",").alias("counts"),
                     F.array_join(taxa.richness_group_keys(F.col("m")), ",").alias("group_keys"))


def stripped_richness(spark, sf):
    df = _species_by_part(spark, sf)
    return df.select("p_partkey", F.array_join(taxa.stripped_names("species"), "#").alias("names"))


# Staged backbone: names are looked up as written; ranks come from nation and region.
BACKBONE = """
SELECT name, CAST(1000 + k AS BIGINT) AS usage_key, name AS scientific_name, name AS canonical_name, 'SPECIES' AS rank,
  CAST(60 + (k * 7) % 41 AS INT) AS confidence, CASE k % 5 WHEN 0 THEN 'HIGHERRANK' WHEN 1 THEN 'FUZZY' WHEN 2 THEN 'NONE' ELSE 'EXACT' END AS match_type,
  'Animalia' AS kingdom, CASE k % 3 WHEN 0 THEN 'Arthropoda' ELSE 'Chordata' END AS phylum, CASE k % 4 WHEN 1 THEN 'Aves' WHEN 2 THEN 'Mammalia' END AS class,
  CASE k % 6 WHEN 3 THEN 'Coleoptera' END AS "order", CASE k % 9 WHEN 3 THEN 'Curculionidae' END AS family, n_name AS genus
FROM (SELECT name, k, n_name FROM (SELECT upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS name, min(p_partkey) AS k FROM {part} GROUP BY 1
        UNION ALL SELECT p_name, min(p_partkey) + 7 FROM {part} GROUP BY p_name) u
      JOIN {nation} ON n_nationkey = k % 25) b"""


def _backbone(spark, sf):
    return derived(spark, sf, BACKBONE.replace('"order"', "`order`"))


def taxon_resolve(spark, sf):
    resolved = tx.resolve_taxa(_species_by_part(spark, sf), "p_partkey", _backbone(spark, sf))
    return resolved.select("p_partkey", "pos", "original", F.col("taxon.usage_key").alias("usage_key"),
                           F.col("taxon.match_type").alias("match_type"), F.col("taxon.confidence").alias("confidence"))


def taxon_resolve_no_higher_rank(spark, sf):
    resolved = tx.resolve_taxa(_species_by_part(spark, sf), "p_partkey", _backbone(spark, sf), accept_higherrank=False,
                               confidence_threshold=70)
    return resolved.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.count("taxon").alias("resolved"))


def broad_groups(spark, sf):
    df = tx.enrich(_species_by_part(spark, sf), "p_partkey", _backbone(spark, sf))
    return df.select("p_partkey", F.array_join("taxon_broad_group_labels", ",").alias("labels"),
                     F.array_join(F.col("gbif_keys").cast("array<string>"), ",").alias("keys"))


def _taxonomy(spark, sf):
    truth = _species_by_part(spark, sf)
    n = derived(spark, sf, NAMES)
    pred = n.select("p_partkey", F.array(F.concat(F.col("p_size").cast("string"), F.lit(" "), "p_name", F.lit(" species")),
                                         "sci").alias("species"))
    return tx.evaluate_taxonomy(truth, pred, "p_partkey", _backbone(spark, sf))


def taxonomy_eval(spark, sf):
    return ev.field_metrics(_taxonomy(spark, sf)).select("field", "tp", "fp", "fn", "tn", "n", "exact_matches")


def taxonomy_eval_derived(spark, sf):
    """The four exact comparison fields: counts, group keys, group labels, backbone keys."""
    n = derived(spark, sf, NAMES)
    pred = n.select("p_partkey", F.array(F.concat(F.col("p_size").cast("string"), F.lit(" "), "p_name", F.lit(" species")),
                                         "sci").alias("species"))
    fields = ["species_richness_counts", "species_richness_group_keys", "taxon_broad_group_labels", "gbif_keys"]
    aligned = tx.evaluate_taxonomy(_species_by_part(spark, sf), pred, "p_partkey", _backbone(spark, sf), fields=fields)
    return ev.field_metrics(aligned).select("field", "tp", "fp", "fn", "tn", "n", "exact_matches")


def mismatch_recovery(spark, sf):
    return mm.recovery_summary(mm.recovery_buckets(_taxonomy(spark, sf)))


# ---- Oracle ----------------------------------------------------------------

_RATIO = """(CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE
 200.0 * list_reduce(list_transform(string_split({a}, ''), lambda c: [ord(c)]),
   lambda prev, ch: list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j]),
     lambda acc, j: list_append(acc, CASE WHEN ord(substr({b}, j[1], 1)) = ch[1] THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], acc[-1]) END), [0]),
   list_transform(range(0, length({b}) + 1), lambda z: 0))[-1] / (length({a}) + length({b})) END)"""

_OUTCOME = """CAST(k AS INT) AS tp, CAST(np - k AS INT) AS fp, CAST(nt - k AS INT) AS fn, 0 AS tn, np = k AND nt = k AS match"""


def _fuzzy_sql(threshold: int) -> str:
    """Best truth per prediction by score, first truth on ties; then set algebra."""
    return f"""
WITH n AS ({plain(NAMES)}),
t AS (SELECT p_partkey, i AS ti, trim(lower(CASE i WHEN 1 THEN p_name ELSE p_brand END)) AS tv FROM n, range(1, 3) r(i)),
p AS (SELECT p_partkey, i AS pi, trim(lower(CASE i WHEN 1 THEN typo WHEN 2 THEN p_brand ELSE ver END)) AS pv FROM n, range(1, 4) r(i)),
pairs AS (SELECT DISTINCT tv, pv FROM t JOIN p USING (p_partkey)),
scored AS (SELECT tv, pv, {_RATIO.format(a='tv', b='pv')} AS s FROM pairs),
best AS (SELECT p.p_partkey, p.pi, p.pv, max(s) AS top, arg_min(tv, (-s, ti)) AS name FROM p JOIN t USING (p_partkey) JOIN scored USING (tv, pv) GROUP BY ALL),
canon AS (SELECT p_partkey, CASE WHEN top >= {threshold} THEN name ELSE pv END AS v FROM best),
ts AS (SELECT p_partkey, list(DISTINCT tv) AS tl FROM t GROUP BY 1), ps AS (SELECT p_partkey, list(DISTINCT v) AS pl FROM canon GROUP BY 1),
o AS (SELECT p_partkey, len(tl) AS nt, len(pl) AS np, len(list_intersect(tl, pl)) AS k FROM ts JOIN ps USING (p_partkey)),
res AS (SELECT p_partkey, {_OUTCOME} FROM o)"""


_PARTS = """CASE WHEN regexp_full_match(trim({v}), '[^()]+\\([^()]+\\)') THEN
   CASE WHEN regexp_matches(trim(split_part({v}, '(', 1)), '^[A-Z]\\S*\\s+[a-z]') THEN [lower(trim(split_part({v}, '(', 1))), lower(trim(rtrim(split_part({v}, '(', 2), ')')))]
     WHEN regexp_matches(trim(split_part({v}, '(', 2)), '^[A-Z]\\S*\\s+[a-z]') THEN [lower(trim(rtrim(split_part({v}, '(', 2), ')'))), lower(trim(split_part({v}, '(', 1)))]
     ELSE [lower(trim({v}))] END
   ELSE [lower(trim({v})), lower(trim({v}))] END"""

_TAXON = f"""
WITH n AS ({plain(NAMES)}),
t AS (SELECT p_partkey, i AS ti, CASE i WHEN 1 THEN sci ELSE ver || ' (' || p_brand || ')' END AS tv FROM n, range(1, 3) r(i)),
p AS (SELECT p_partkey, i AS pi, CASE i WHEN 1 THEN ver || ' (' || sci || ')' WHEN 2 THEN p_brand || ' of ' || typo ELSE sci || ' (' || ver || ')' END AS pv FROM n, range(1, 4) r(i)),
pairs AS (SELECT DISTINCT tv, pv, lower(tv) AS tl, lower(pv) AS pl, {_PARTS.format(v='tv')} AS tp, {_PARTS.format(v='pv')} AS pp FROM t JOIN p USING (p_partkey)),
flat AS (SELECT DISTINCT a, b FROM (SELECT tl AS a, pl AS b FROM pairs UNION ALL SELECT unnest(tp) AS a, b FROM (SELECT tp, unnest(pp) AS b FROM pairs))),
ratios AS (SELECT a, b, {_RATIO.format(a='a', b='b')} AS s FROM flat),
part_scores AS (SELECT tv, pv, x.i AS i, y.j AS j, r.s FROM pairs, range(1, len(tp) + 1) x(i), range(1, len(pp) + 1) y(j), ratios r WHERE r.a = tp[x.i] AND r.b = pp[y.j]),
first_part AS (SELECT tv, pv, arg_min(s, (i, j)) FILTER (s >= 70) AS fs, max(s) AS ms FROM part_scores GROUP BY 1, 2),
scored AS (SELECT q.tv, q.pv, q.tl, CASE WHEN q.tl = q.pl THEN 100.0 WHEN r.s >= 70 THEN r.s WHEN f.fs IS NOT NULL THEN f.fs
   WHEN contains(q.pl, q.tl) THEN 95.0 WHEN len(list_filter(q.tp, lambda z: contains(q.pl, z))) > 0 THEN 90.0 ELSE greatest(r.s, f.ms) END AS s
   FROM pairs q JOIN ratios r ON r.a = q.tl AND r.b = q.pl JOIN first_part f ON f.tv = q.tv AND f.pv = q.pv),
best AS (SELECT p.p_partkey, p.pi, lower(p.pv) AS pv, max(s) AS top, arg_min(tl, (-s, ti)) AS name FROM p JOIN t USING (p_partkey) JOIN scored s ON s.tv = t.tv AND s.pv = p.pv GROUP BY ALL),
canon AS (SELECT p_partkey, CASE WHEN top >= 70 THEN name ELSE pv END AS v FROM best),
ts AS (SELECT p_partkey, list(DISTINCT lower(tv)) AS tl FROM t GROUP BY 1), ps AS (SELECT p_partkey, list(DISTINCT v) AS pl FROM canon GROUP BY 1),
o AS (SELECT p_partkey, len(tl) AS nt, len(pl) AS np, len(list_intersect(tl, pl)) AS k FROM ts JOIN ps USING (p_partkey))
SELECT p_partkey, {_OUTCOME} FROM o"""

_SCI = "regexp_matches({x}, '^[A-Z]\\S*\\s+[a-z]')"
_PAREN = "regexp_full_match(nm, '[^()]+\\([^()]+\\)')"
_APPROX = "(?:c(?:irca)?\\.?|ca\\.?|approx(?:\\.|imately)?|about|around)"


def _group_sql(x: str) -> str:
    s = f"regexp_replace(trim({x}), '\\([^()]*\\)', ' ', 'g')"
    s = f"regexp_replace({s}, '\\b(?:and others?|others?)\\b', ' ', 'gi')"
    s = f"regexp_replace({s}, '^(?:species|taxa|taxon)\\s+of\\s+', '', 'i')"
    s = f"regexp_replace({s}, '^(?:the|a|an)\\s+', '', 'i')"
    s = f"regexp_replace({s}, '\\b(?:species|taxa|taxon|morphospecies|otus?)\\b', ' ', 'gi')"
    s = f"lower(trim(regexp_replace(trim({s}, ' ,.;:-'), '\\s+', ' ', 'g')))"
    return s


def _singular_sql(g: str) -> str:
    last = f"string_split({g}, ' ')[-1]"
    return f"""CASE WHEN {g} = '' THEN NULL WHEN length({last}) <= 3 THEN {g} WHEN length({last}) > 4 AND {g} LIKE '%ies' THEN regexp_replace({g}, 'ies$', 'y')
      WHEN length({last}) > 4 AND {g} LIKE '%ses' THEN regexp_replace({g}, 'es$', '') WHEN {g} LIKE '%s' AND NOT regexp_matches({g}, '(ss|us|is)$') THEN regexp_replace({g}, 's$', '') ELSE {g} END"""


_TERMS = "'" + "', '".join(taxa.GROUP_TERMS) + "'"
_PARSED = f"""
raws AS ({plain(RAW)}), items AS (SELECT p_partkey, 0 AS pos, raw FROM raws UNION ALL SELECT p_partkey, 1, p_name FROM part),
c1 AS (SELECT *, trim(raw) AS s, regexp_matches(trim(raw), '^[0-9]+\\s+') AS counted FROM items),
c2 AS (SELECT *, CASE WHEN counted THEN CAST(regexp_extract(s, '^([0-9]+)', 1) AS BIGINT) END AS cnt,
   CASE WHEN counted THEN trim(regexp_replace(s, '^[0-9]+\\s+', '')) ELSE s END AS rest FROM c1),
c3 AS (SELECT *, CASE WHEN lower(rest) LIKE '%mock species' THEN trim(substr(rest, 1, length(rest) - 12)) ELSE rest END AS r2 FROM c2),
c4 AS (SELECT *, CASE WHEN lower(r2) LIKE '%species' THEN trim(substr(r2, 1, length(r2) - 7)) ELSE r2 END AS nm FROM c3),
c5 AS (SELECT *, CASE WHEN {_PAREN} THEN trim(split_part(nm, '(', 1)) END AS bef, CASE WHEN {_PAREN} THEN trim(rtrim(split_part(nm, '(', 2), ')')) END AS ins FROM c4),
parsed AS (SELECT p_partkey, pos, raw AS original, cnt,
   CASE WHEN bef IS NOT NULL THEN CASE WHEN {_SCI.format(x='bef')} THEN bef WHEN {_SCI.format(x='ins')} THEN ins END WHEN {_SCI.format(x='nm')} THEN nm END AS sci,
   CASE WHEN bef IS NOT NULL AND {_SCI.format(x='bef')} THEN ins WHEN bef IS NOT NULL AND {_SCI.format(x='ins')} THEN bef
     WHEN bef IS NOT NULL THEN nm WHEN {_SCI.format(x='nm')} THEN NULL ELSE nm END AS ver FROM c5),
flagged AS (SELECT *, cnt IS NOT NULL OR trim(lower(coalesce(sci, ver))) IN ({_TERMS}) AS is_group FROM parsed),
m1 AS (SELECT p_partkey, pos, regexp_matches(trim(raw), '(?i)^\\s*{_APPROX}\\s*') AS approx, trim(regexp_replace(trim(raw), '(?i)^\\s*{_APPROX}\\s*', '')) AS r FROM items),
m2 AS (SELECT *, CASE WHEN regexp_matches(r, '^[0-9]+\\s+') THEN CAST(regexp_extract(r, '^([0-9]+)', 1) AS BIGINT) END AS cnt,
   {_group_sql("regexp_replace(r, '^[0-9]+\\s+', '')")} AS g FROM m1),
mentions AS (SELECT p_partkey, pos, approx, cnt, CASE WHEN cnt IS NOT NULL THEN {_singular_sql('g')} END AS grp FROM m2)"""

_RESOLVED = f"""
WITH {_PARSED}, backbone AS ({plain(BACKBONE)}),
cand AS (SELECT p_partkey, pos, 0 AS k, sci AS name FROM flagged WHERE sci <> '' UNION ALL
  SELECT p_partkey, pos, 1, ver FROM flagged WHERE ver <> '' UNION ALL
  SELECT p_partkey, pos, 2, trim(original) FROM flagged WHERE coalesce(sci, '') = '' AND coalesce(ver, '') = ''),
hit AS (SELECT c.*, b.* EXCLUDE (name) FROM cand c JOIN backbone b ON c.name = b.name
  WHERE match_type <> 'NONE' AND confidence >= {{conf}} AND ({{higher}} OR match_type <> 'HIGHERRANK')),
pick AS (SELECT DISTINCT ON (p_partkey, pos) * FROM hit ORDER BY p_partkey, pos, k),
res AS (SELECT f.p_partkey, f.pos, f.original, pick.* EXCLUDE (p_partkey, pos, name, k) FROM flagged f LEFT JOIN pick USING (p_partkey, pos))"""


def _resolved(conf: int = 80, higher: bool = True) -> str:
    return _RESOLVED.replace("{conf}", str(conf)).replace("{higher}", str(higher).lower())


_LABEL = "coalesce(" + ", ".join("CASE upper({c}) {w} END".format(
    c='"order"' if rank == "order" else rank, w=" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in taxa.RANK_GROUP_LABELS[rank].items()))
    for rank in ("family", "order", "class", "phylum")) + ")"

QUERIES = {f.__name__: f for f in (
    eval_fuzzy_list, eval_fuzzy_metrics, eval_fuzzy_scalar, indel_similarity, eval_taxon_list,
    eval_taxon_list_join, taxon_name_parts, species_parse,
    richness_mentions, richness_keys, stripped_richness, taxon_resolve, taxon_resolve_no_higher_rank, broad_groups,
    taxonomy_eval, taxonomy_eval_derived, mismatch_recovery)}


def _derived_fields(items: str) -> str:
    """Per-record derived value lists (as texts) for one side."""
    base = _resolved().replace("SELECT p_partkey, 0 AS pos, raw FROM raws UNION ALL SELECT p_partkey, 1, p_name FROM part", items)
    return base + f""", labels AS (SELECT p_partkey, grp AS l FROM mentions WHERE grp IS NOT NULL UNION
      SELECT p_partkey, {_singular_sql('g')} FROM (SELECT p_partkey, {_group_sql('ver')} AS g FROM flagged WHERE is_group AND ver <> '') UNION
      SELECT p_partkey, {_LABEL} FROM res)
    SELECT p_partkey, 'taxon_broad_group_labels' AS field, l AS v FROM labels WHERE l IS NOT NULL
    UNION SELECT p_partkey, 'gbif_keys', CAST(usage_key AS VARCHAR) FROM res WHERE usage_key IS NOT NULL
    UNION SELECT p_partkey, 'species_richness_group_keys', cnt || '|' || grp FROM mentions WHERE grp IS NOT NULL
    UNION SELECT p_partkey, 'species_richness_counts', CAST(cnt AS VARCHAR) FROM mentions WHERE cnt IS NOT NULL
    UNION SELECT p_partkey, 'species_richness_counts', CAST(count(*) AS VARCHAR) FROM mentions GROUP BY 1 HAVING count(cnt) = 0"""


_PRED_ITEMS = """SELECT p_partkey, 0 AS pos, p_size || ' ' || p_name || ' species' AS raw FROM part
  UNION ALL SELECT p_partkey, 1, upper(substr(p_name, 1, 1)) || substr(p_name, 2) FROM part"""

ORACLE = {
    "taxonomy_eval_derived": f"""WITH t AS ({_derived_fields("SELECT p_partkey, 0 AS pos, raw FROM raws UNION ALL SELECT p_partkey, 1, p_name FROM part")}),
      p AS ({_derived_fields(_PRED_ITEMS)}),
      f AS (SELECT unnest(['species_richness_counts', 'species_richness_group_keys', 'taxon_broad_group_labels', 'gbif_keys']) AS field),
      j AS (SELECT f.field, k.p_partkey, (SELECT count(*) FROM t WHERE t.field = f.field AND t.p_partkey = k.p_partkey) AS nt,
        (SELECT count(*) FROM p WHERE p.field = f.field AND p.p_partkey = k.p_partkey) AS np,
        (SELECT count(*) FROM t JOIN p USING (p_partkey, field, v) WHERE t.field = f.field AND t.p_partkey = k.p_partkey) AS k FROM part k, f)
      SELECT field, CAST(sum(k) AS BIGINT) AS tp, CAST(sum(np - k) AS BIGINT) AS fp, CAST(sum(nt - k) AS BIGINT) AS fn,
        count(*) FILTER (nt = 0 AND np = 0) AS tn, count(*) AS n, count(*) FILTER (nt = k AND np = k) AS exact_matches FROM j GROUP BY field""",
    "eval_fuzzy_list": _fuzzy_sql(80) + " SELECT * FROM res",
    "eval_fuzzy_metrics": _fuzzy_sql(70) + """, c AS (SELECT CAST(sum(tp) AS BIGINT) tp, CAST(sum(fp) AS BIGINT) fp, CAST(sum(fn) AS BIGINT) fn,
      CAST(sum(tn) AS BIGINT) tn, count(*) AS n, count(*) FILTER (match) AS exact_matches FROM res)
      SELECT 'species' AS field, *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2.0 * tp / (2 * tp + fp + fn) AS f1,
      (tp + tn) / n AS accuracy_raw, exact_matches / n AS exact_match_rate FROM c""",
    "eval_fuzzy_scalar": f"""WITH n AS ({plain(NAMES)}), s AS (SELECT p_partkey, {_RATIO.format(a='p_name', b='typo')} >= 85 AS ok FROM n)
      SELECT p_partkey, CAST(ok AS INT) AS tp, CAST(NOT ok AS INT) AS fp, CAST(NOT ok AS INT) AS fn, 0 AS tn, ok AS match FROM s""",
    "indel_similarity": f"""WITH n AS (SELECT DISTINCT p_name, typo FROM ({plain(NAMES)}))
      SELECT p_name, typo, round({_RATIO.format(a='p_name', b='typo')}, 6) AS score FROM n""",
    "eval_taxon_list": _TAXON,
    "eval_taxon_list_join": _TAXON,
    "taxon_name_parts": f"""WITH n AS ({plain(NAMES)}), p AS (SELECT DISTINCT CASE i WHEN 1 THEN ver || ' (' || sci || ')'
      WHEN 2 THEN p_brand || ' of ' || typo ELSE sci || ' (' || ver || ')' END AS name FROM n, range(1, 4) r(i)),
      q AS (SELECT name, {_PARTS.format(v='name')} AS parts, contains(name, '(') AS paren FROM p)
      SELECT name, lower(parts[1]) AS scientific, CASE WHEN paren THEN parts[2] END AS vernacular, CASE WHEN NOT paren THEN parts[1] END AS "full" FROM q""",
    "species_parse": f"""WITH {_PARSED} SELECT p_partkey, original, sci AS scientific, ver AS vernacular, cnt AS "count", is_group AS is_group_description
      FROM flagged WHERE pos = 0""",
    "richness_mentions": f"""WITH {_PARSED} SELECT p_partkey, cnt AS "count", grp AS normalized_group, approx AS approximate FROM mentions WHERE pos = 0""",
    "richness_keys": f"""WITH {_PARSED}, k AS (SELECT p_partkey, list_sort(list(DISTINCT cnt) FILTER (cnt IS NOT NULL)) AS cs,
      list_sort(list(DISTINCT cnt || '|' || grp) FILTER (grp IS NOT NULL)) AS gs FROM mentions GROUP BY 1)
      SELECT p_partkey, coalesce(array_to_string(cs, ','), '2') AS counts, array_to_string(gs, ',') AS group_keys FROM k""",
    "stripped_richness": f"""WITH {_PARSED}, pieces AS (SELECT p_partkey, pos, p.i, trim(regexp_replace(x[p.i], '\\s+', ' ', 'g'), ' ,.;:-') AS v, x[p.i] AS rawp FROM
      (SELECT p_partkey, pos, string_split_regex(trim(raw), '(?i)\\s*(?:,|;|/|\\||&|\\+|\\band\\b)\\s*') AS x FROM items), range(1, len(x) + 1) p(i)),
      kept AS (SELECT p_partkey, arg_min(v, (pos, i)) AS v, min((pos, i)) AS o FROM pieces
        WHERE NOT regexp_matches(rawp, '(?i)\\b(?:{_APPROX}\\s*)?\\d+(?:\\.\\d+)?\\b') AND regexp_matches(v, '[A-Za-z]') GROUP BY p_partkey, lower(v))
      SELECT p.p_partkey, string_agg(v, '#' ORDER BY o) AS names FROM part p LEFT JOIN kept k ON p.p_partkey = k.p_partkey GROUP BY 1""",
    "taxon_resolve": _resolved() + " SELECT p_partkey, pos, original, usage_key, match_type, confidence FROM res",
    "taxon_resolve_no_higher_rank": _resolved(70, False) + " SELECT pos, count(*) AS n, count(usage_key) AS resolved FROM res GROUP BY pos",
    "broad_groups": _resolved() + f""", labels AS (SELECT p_partkey, grp AS l FROM mentions WHERE grp IS NOT NULL UNION
      SELECT p_partkey, {_singular_sql('g')} FROM (SELECT p_partkey, {_group_sql('ver')} AS g FROM flagged WHERE is_group AND ver <> '') UNION
      SELECT p_partkey, {_LABEL} FROM res),
      agg AS (SELECT p_partkey, list_sort(list(DISTINCT l) FILTER (l IS NOT NULL)) AS ls FROM labels GROUP BY 1),
      ks AS (SELECT p_partkey, list_sort(list(DISTINCT usage_key) FILTER (usage_key IS NOT NULL)) AS kk FROM res GROUP BY 1)
      SELECT p.p_partkey, array_to_string(ls, ',') AS labels, array_to_string(kk, ',') AS keys FROM part p
      LEFT JOIN agg USING (p_partkey) LEFT JOIN ks USING (p_partkey)""",
}
