"""Manifest, DOI, registry, run and relevance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat.functions import cost, doi
from concordat.operators import embedding_cache as ec
from concordat.operators import evaluate as ev
from concordat.operators import manifest as mf
from concordat.operators import registry as rg
from concordat.operators import relevance as rel
from concordat.operators import runs, tables
from concordat.plans.base import derived, plain, table
from concordat.sources import readers, staged

# ---- Manifest --------------------------------------------------------------

SHEET = """
SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'dryad' WHEN 1 THEN 'zenodo' WHEN 2 THEN 'semantic_scholar' ELSE ' ' END AS source,
  CASE WHEN o_orderkey % 9 = 0 THEN 'https://example.org/' || o_orderkey ELSE 'https://doi.org/10.5061/DRYAD.' || o_orderkey END AS source_url,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'doi:10.1111/MEC.' || o_custkey WHEN 2 THEN ' 10.1038/s' || o_custkey ELSE 'none' END AS cited_article_doi,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 2 AS DOUBLE) END AS is_oa, CASE WHEN o_orderkey % 6 = 0 THEN 'https://a.org/x.pdf' END AS pdf_url,
  'Order ' || o_orderkey AS title, CASE WHEN o_orderstatus = 'P' THEN 'no' ELSE 'yes' END AS valid_yn FROM {orders}"""
RAW = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE ' Text of ' || o_orderpriority END AS full_text FROM {orders}"
# Several download attempts per record: line items; the last line counts.
PDFS = """
SELECT l_orderkey AS record_id, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey AS ord, CASE WHEN l_returnflag = 'R' THEN '' ELSE 'y' || l_suppkey || chr(92) || 'p' || l_partkey || '.pdf' END AS downloaded_pdf_path,
  CASE WHEN l_linestatus = 'O' THEN 'https://p.org/' || l_partkey END AS pdf_url_xlsx, CASE WHEN l_returnflag = 'A' THEN l_linestatus = 'O' END AS is_oa FROM {lineitem}"""


def _pdfs(spark, sf):
    return derived(spark, sf, PDFS)


def _manifest(spark, sf):
    return mf.build(derived(spark, sf, SHEET), _pdfs(spark, sf), raw=derived(spark, sf, RAW), order="ord")


def manifest_build(spark, sf):
    return _manifest(spark, sf)


def manifest_coverage(spark, sf):
    files = _pdfs(spark, sf).filter("downloaded_pdf_path LIKE '%5.pdf'").select(
        F.concat(F.lit("data/pdfs/"), F.translate("downloaded_pdf_path", "\\", "/")).alias("path"))
    return mf.pdf_coverage(_manifest(spark, sf), files)


def coverage_by_source(spark, sf):
    return mf.coverage_by_source(derived(spark, sf, SHEET).join(derived(spark, sf, RAW), "id"))


def dataset_kpis(spark, sf):
    return mf.dataset_kpis(derived(spark, sf, SHEET))


def dup_keys(spark, sf):
    return mf.duplicate_keys(_pdfs(spark, sf), "record_id")


def record_index_merge(spark, sf):
    """Manifest index completed from the annotation sheet, column by column."""
    merged = mf.first_known(readers.record_index(_manifest(spark, sf)), readers.sheet_index(derived(spark, sf, SHEET)), "id")
    return merged.select("id", "title", "source", "pdf_url", "is_oa", "valid_yn", "doi")


def mapping_enrichment(spark, sf):
    """Known mapping filled from new lookups, then rows it did not have yet appended."""
    sheet = derived(spark, sf, SHEET).select("id", F.col("cited_article_doi").alias("article_doi"), "source")
    known = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("article_doi"),
                                                F.lit("mapping").alias("source"))
    return mf.append_new(mf.fill_from(known, sheet, "id", ["article_doi"]), sheet, "id")


def method_summary(spark, sf):
    """Stacked tables, the last row per key wins."""
    a = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    b = table(spark, sf, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    return mf.stack_keep_last([a, b], "key")


def article_mapping(spark, sf):
    rows = derived(spark, sf, SHEET).select("id", F.when(F.col("id") % 7 == 0, F.lit("10.5281/zenodo.1")).when(
        F.col("id") % 11 == 0, F.lit("10.1/a;10.1/b")).otherwise(doi.from_url("cited_article_doi")).alias("article_doi"))
    return readers.article_dois(rows)


def pdf_fallback_chain(spark, sf):
    rows = derived(spark, sf, SHEET).select(
        "id", doi.normalize_or_null(doi.from_url("cited_article_doi")).alias("doi"), F.lit(None).cast("string").alias("existing_path"),
        F.col("pdf_url").alias("work_pdf_url"), F.when(F.col("is_oa") == 1, F.array(F.col("pdf_url"), F.col("source_url"))).alias("oa_pdf_urls"))
    return mf.pdf_source(rows).select("id", "pdf_strategy", "pdf_source")


DOIS = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://doi.org/10.5061/Dryad.' || page_id || '(A)' WHEN 1 THEN ' DOI:10.1371/' || url WHEN 2 THEN url
  WHEN 3 THEN '10.1007/978-' || page_id || '%28x' ELSE '' END AS raw FROM {pages}"""


def doi_normalize(spark, sf):
    d = derived(spark, sf, DOIS)
    return d.select("page_id", doi.strip_prefix("raw").alias("bare"), doi.normalize("raw").alias("doi"), doi.from_url("raw").alias("extracted"),
                    doi.filename_stem("raw").alias("stem"), doi.sanitize("raw").alias("safe"), doi.mentions_doi("raw").alias("mentions"),
                    doi.same("raw", F.upper("raw")).alias("same_upper"), doi.publisher_pdf_url(doi.normalize("raw")).alias("pdf"))


def doi_variants(spark, sf):
    d = derived(spark, sf, DOIS)
    return d.select("page_id", F.posexplode(doi.candidate_variants("raw")).alias("pos", "variant"))


def catalogue_lookup(spark, sf):
    """Requested DOIs against a staged catalogue, by normalised DOI."""
    requests = derived(spark, sf, SHEET).select("id", F.col("cited_article_doi").alias("doi"))
    works = table(spark, sf, "customer").select(F.concat(F.lit("https://doi.org/10.1111/mec."), "c_custkey").alias("doi"), "c_name")
    works = works.unionByName(works.select("doi", F.concat(F.lit("later "), "c_name").alias("c_name")))  # every DOI twice
    return staged.lookup_by_doi(requests, works).select("id", "found_c_name")


def citation_edges(spark, sf):
    """Line items as edges supplier -> part: who cites part 7, and what supplier 7 refers to."""
    edges = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("citing"), F.col("l_partkey").cast("string").alias("cited"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("paper_id"), F.col("s_name").alias("name"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("paper_id"), F.col("p_name").alias("name"))
    return staged.citing(edges, suppliers, "7").withColumn("kind", F.lit("citing")).unionByName(
        staged.references(edges, parts, "7").withColumn("kind", F.lit("reference")))


def observation_summary(spark, sf):
    obs = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id_taxa_obs"), F.year("l_shipdate").alias("year"))
    groups = table(spark, sf, "part").select(F.col("p_partkey").alias("id_taxa_obs"), F.col("p_type").alias("group_name"))
    return staged.observation_summary(obs, groups, years=(1996, 2000))


# ---- Keyed tables ----------------------------------------------------------

CURRENT = "SELECT o_orderkey AS work_id, 'PENDING' AS status, CAST(o_custkey AS STRING) AS note, CAST(0 AS BIGINT) AS ord FROM {orders}"
UPDATES = """SELECT l_orderkey AS work_id, CASE l_returnflag WHEN 'A' THEN 'PARSED' WHEN 'N' THEN 'INDEXED' ELSE 'ERROR' END AS status,
  l_linestatus AS note, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey AS ord FROM {lineitem}
  UNION ALL SELECT -1 - p_partkey, 'PENDING', p_brand, CAST(1 AS BIGINT) FROM {part}"""


def upsert_latest(spark, sf):
    return tables.merge_latest(derived(spark, sf, CURRENT), derived(spark, sf, UPDATES), "work_id", "ord")


def upsert_two_columns(spark, sf):
    """Existing rows refresh only status and order; new keys are inserted whole."""
    return tables.merge_latest(derived(spark, sf, CURRENT), derived(spark, sf, UPDATES), "work_id", "ord", only=["status", "ord"])


def delete_cascade(spark, sf):
    docs = derived(spark, sf, CURRENT)
    chunks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("work_id"), "l_linenumber")
    doomed = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("work_id"))
    kept_docs, kept_chunks = rg.cascade(docs, chunks, doomed)
    return kept_docs.select(F.lit("documents").alias("name"), F.col("work_id").cast("bigint").alias("work_id"), F.lit(0).alias("part")).unionByName(
        kept_chunks.select(F.lit("chunks").alias("name"), F.col("work_id").cast("bigint").alias("work_id"), F.col("l_linenumber").alias("part")))


def pending_documents(spark, sf):
    """Idempotent rerun: documents whose latest state is not final."""
    state = tables.merge_latest(derived(spark, sf, CURRENT), derived(spark, sf, UPDATES), "work_id", "ord")
    finished = state.filter(F.col("status").isin("INDEXED")).select("work_id")
    return derived(spark, sf, CURRENT).select("work_id").join(finished, "work_id", "left_anti")


def sha_collisions(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("work_id"), F.sha2("text", 256).alias("pdf_sha256"))
    return rg.sha_collisions(docs)


def embedding_cache_diff(spark, sf):
    """Chunks against cached vectors: hit only when text, model and size agree."""
    chunks = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    vectors = table(spark, sf, "embeddings")
    cache = table(spark, sf, "documents").join(vectors, F.col("doc_id") == F.col("vec_id")).select(
        F.col("doc_id").cast("string").alias("chunk_id"),
        F.sha2(F.when(F.col("label") % 3 == 0, F.upper("text")).otherwise(F.col("text")), 256).alias("text_hash"),
        F.when(F.col("label") % 4 == 1, "other-model").otherwise("model").alias("model"), F.size("embedding").alias("dimensions"), "embedding")
    found = ec.cache_lookup(chunks, cache, model="model", dimensions=64)
    return found.select("chunk_id", "text_hash", "hit", F.size("embedding").alias("dims"))


# ---- Runs and cost ---------------------------------------------------------

USAGE = """SELECT l_orderkey * 10 + l_linenumber AS gt_record_id, l_returnflag AS source, CASE l_linestatus WHEN 'O' THEN 'run_b' ELSE 'run_a' END AS run,
  CASE WHEN l_quantity > 45 THEN 'error' WHEN l_quantity < 4 THEN 'skipped' ELSE 'success' END AS status, CAST(floor(l_extendedprice) AS BIGINT) AS input_tokens,
  CAST(floor(l_quantity * 100) AS BIGINT) AS cached_tokens, CAST(floor(l_quantity * 10) AS BIGINT) AS output_tokens, CAST(floor(l_discount * 1000 + 0.5) AS BIGINT) AS reasoning_tokens,
  l_tax > 0.07 AS memo_hit, CASE WHEN l_quantity > 20 THEN l_returnflag ELSE ' ' END AS f_text, CASE WHEN l_tax > 0.02 THEN l_partkey END AS f_number,
  CASE WHEN l_discount > 0.05 THEN l_linestatus END AS f_flag FROM {lineitem}"""


def _records(spark, sf):
    u = derived(spark, sf, USAGE)
    usage = cost.usage_cost(F.lit("gpt-5-mini"), F.col("input_tokens"), F.least("cached_tokens", "input_tokens"), F.col("reasoning_tokens"),
                            F.col("output_tokens"), F.col("memo_hit"))
    ok = F.col("status") == "success"
    return u.select("gt_record_id", "source", "run", "status", F.when(ok, usage).alias("usage_cost"), F.when(ok, F.struct(
        F.col("f_text").alias("species"), F.col("f_number").alias("temp_range_i"), F.col("f_flag").alias("time_series"))).alias("output"))


def cost_accounting(spark, sf):
    costed = runs.with_cost_columns(_records(spark, sf), F.lit("gpt-5-mini"))
    return costed.groupBy("source", "cache_status").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("cost_used_usd"), 4).alias("used"), F.round(F.sum("cost_value_usd"), 4).alias("value"),
        F.round(F.sum("cache_savings_usd"), 4).alias("savings"), F.sum("input_tokens_used").alias("tokens_used"))


def run_kpis(spark, sf):
    k = runs.run_kpis(_records(spark, sf), F.lit("gpt-5-mini"), by=["run"])
    return k.withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in ("cost_used_usd", "cost_value_usd", "cache_savings_usd", "avg_cost_value_usd")})


def fill_rate(spark, sf):
    return runs.fill_rate(_records(spark, sf))


def cost_by_source(spark, sf):
    c = runs.cost_by(_records(spark, sf), ["source"])
    return c.withColumns({n: F.round(F.col(n) + 1e-9, 4) for n in ("total_cost", "avg_cost", "avg_input_tokens", "avg_output_tokens")})


def extraction_csv_rows(spark, sf):
    t = runs.extraction_table(_records(spark, sf))
    return t.select("gt_record_id", "status", "cost_usd", "species", "temp_range_i", "time_series")


def run_records_status(spark, sf):
    """Run records of the abstract mode: skipped without text, error without output."""
    extractions = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("gt_record_id"), F.when(F.col("o_orderstatus") != "P", F.struct(F.col("o_orderpriority").alias("species"))).alias("output"),
        F.lit(None).cast("string").alias("usage_cost"), F.when(F.col("o_orderkey") % 10 == 1, F.lit("Timeout: x")).alias("error"))
    return runs.run_records(_manifest(spark, sf), "abstract", extractions).select("gt_record_id", "record_id", "status", "error_message", "extraction_method")


RUN_TRUTH = "SELECT l_orderkey * 10 + l_linenumber AS rid, l_returnflag AS f1, CAST(l_quantity AS INT) AS f2, CASE WHEN l_tax > 0.02 THEN l_linestatus END AS f3, l_suppkey FROM {lineitem}"


def _run_aligned(spark, sf, run):
    """Two runs over the same records with different mistakes."""
    base = derived(spark, sf, f"SELECT DISTINCT rid, f1, f2, f3 FROM (SELECT rid, min(f1) AS f1, min(f2) AS f2, min(f3) AS f3 FROM ({RUN_TRUTH}) r GROUP BY rid) s")
    pred = base.select("rid", F.when(F.col("rid") % (3 + run) == 0, F.lit("Z")).otherwise(F.lower("f1")).alias("f1"),
                       F.when(F.col("rid") % (5 - run) == 0, F.lit(None)).otherwise(F.col("f2")).cast("int").alias("f2"),
                       F.when(F.col("rid") % 2 == run, F.lit("O")).otherwise(F.col("f3")).alias("f3"))
    config = ev.EvalConfig(field_strategies={f: ev.FieldStrategy() for f in ("f1", "f2", "f3")})
    return ev.align(base, pred, "rid", config=config)


def run_compare(spark, sf):
    a, b = (ev.field_metrics(_run_aligned(spark, sf, i)) for i in (0, 1))
    return runs.compare_runs(a, b).select("field", "n_a", "delta_precision", "delta_recall", "delta_f1")


def run_trend_pivot(spark, sf):
    reports = [ev.report(_run_aligned(spark, sf, i)).withColumn("run", F.lit(f"2026010{i + 1}_120000_demo")).withColumn("mode", F.lit("abstract")) for i in (0, 1)]
    trends = runs.trend_rows(reports[0].unionByName(reports[1]))
    pivot = runs.trend_pivot(trends, [ev.MICRO, ev.MACRO, "f1", "f2", "f3"])
    return pivot.select("timestamp", F.round(ev.MICRO, 6).alias("micro"), F.round(ev.MACRO, 6).alias("macro"), *[F.round(f, 6).alias(f) for f in ("f1", "f2", "f3")])


def run_overall_deltas(spark, sf):
    d = runs.overall_deltas(ev.report(_run_aligned(spark, sf, 1)), ev.report(_run_aligned(spark, sf, 0)))
    return d.select("delta_micro_precision", "delta_micro_recall", "delta_micro_f1", "delta_macro_f1", "balance")


# ---- Relevance -------------------------------------------------------------

FEATURES = """SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN 'EBV genetic analysis' WHEN 1 THEN 'genetic analysis' WHEN 2 THEN 'relative abundance' WHEN 3 THEN 'Abundance'
    WHEN 4 THEN 'presence-absence' WHEN 5 THEN 'presence only' WHEN 6 THEN 'other' WHEN 7 THEN NULL ELSE 'traits' END AS raw_data_type,
  CASE o_custkey % 5 WHEN 0 THEN 'density' WHEN 1 THEN 'distribution' WHEN 2 THEN 'genetic_analysis' WHEN 3 THEN 'species_richness' END AS data_type_primary,
  CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 2000 END AS temp_range_i, CAST(2000 + o_orderkey % 16 AS INT) AS temp_range_f,
  CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE o_totalprice / 20 END AS spatial_range_km2, o_orderkey % 11 = 0 AS multispecies,
  CASE o_orderkey % 13 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' END AS threatened_species, CAST(o_orderkey % 2 AS INT) AS bias_north_south,
  CASE o_orderstatus WHEN 'F' THEN 'H' WHEN 'O' THEN CASE WHEN o_custkey % 2 = 0 THEN 'M' ELSE ' X' END ELSE CASE WHEN o_custkey % 3 = 0 THEN 'No dataset' ELSE 'L' END END AS human
  FROM {orders}"""


def _scored(spark, sf):
    df = rel.classify(derived(spark, sf, FEATURES))
    return df.withColumn("human", rel.recode_label("human"))


def relevance_rules(spark, sf):
    return _scored(spark, sf).select("id", "mc_data_type", "mc_temporal", "mc_spatial", "mc_relevance", "pred_relevance", "human")


def confusion_matrix(spark, sf):
    return rel.confusion_matrix(_scored(spark, sf), "human", "pred_relevance")


def class_report(spark, sf):
    return rel.class_report(_scored(spark, sf), "human", "pred_relevance")


def class_report_binary(spark, sf):
    return rel.binary_report(_scored(spark, sf), "human", "pred_relevance")


def class_report_macro(spark, sf):
    return rel.macro_over_present(rel.class_report(_scored(spark, sf).filter("human <> 'X'"), "human", "pred_relevance", truth_only=True))


def mc_audit(spark, sf):
    return rel.column_audit(_scored(spark, sf), [("human", "pred_relevance"), ("human", "mc_relevance"), ("mc_data_type", "mc_spatial")])


def mc_audit_mismatches(spark, sf):
    return rel.audit_mismatches(_scored(spark, sf), "id", [("human", "pred_relevance"), ("mc_data_type", "mc_spatial")])


def relevance_delta(spark, sf):
    df = _scored(spark, sf).withColumnRenamed("human", "gt_relevance")
    other = df.select("id", "gt_relevance", F.col("mc_relevance").alias("pred_relevance"))
    return rel.delta_summary(rel.prediction_delta(df, other, "id"))


# ---- Oracle ----------------------------------------------------------------

_BARE = "trim(regexp_replace(trim(coalesce({x}, '')), '^(https?://doi\\.org/|doi:)', '', 'i'))"
_FROM = "CASE WHEN regexp_matches(" + _BARE + ", '^10\\.[0-9]{{4,}}') THEN " + _BARE + " END"


def _from(x: str) -> str:
    return _FROM.format(x=x)


_M = f"""WITH sheet AS ({plain(SHEET)}), raw AS ({plain(RAW)}), pdfs AS (SELECT DISTINCT ON (record_id) * FROM ({plain(PDFS)}) ORDER BY record_id, ord DESC),
m AS (SELECT s.id AS gt_record_id, nullif(trim(s.source), '') AS source, s.title, nullif(trim(r.full_text), '') AS abstract,
  lower({_from('s.source_url')}) AS source_doi, s.source_url, lower({_from('s.cited_article_doi')}) AS article_doi, CAST(NULL AS VARCHAR) AS article_url,
  coalesce(p.pdf_url_xlsx, s.pdf_url) AS pdf_url, CASE WHEN p.downloaded_pdf_path <> '' THEN 'data/pdfs/' || replace(p.downloaded_pdf_path, '\\', '/') END AS pdf_local_path,
  coalesce(p.is_oa, s.is_oa <> 0) AS is_oa, CAST(NULL AS VARCHAR) AS openalex_id, CAST(NULL AS VARCHAR) AS semantic_scholar_paper_id, CAST(NULL AS VARCHAR) AS article_publisher
  FROM sheet s LEFT JOIN raw r USING (id) LEFT JOIN pdfs p ON p.record_id = s.id)"""
_LATEST = f"""WITH cur AS ({plain(CURRENT)}), upd AS (SELECT DISTINCT ON (work_id) * FROM ({plain(UPDATES)}) ORDER BY work_id, ord DESC)"""
_USAGE = f"""WITH u AS ({plain(USAGE)}), p AS (SELECT *, least(cached_tokens, input_tokens) AS ct FROM u),
c AS (SELECT *, status = 'success' AS ok, format('{{:.4f}}', CAST((input_tokens - ct) * 0.25::DOUBLE / 1000000 AS DOUBLE))::DOUBLE AS ic, format('{{:.4f}}', CAST(ct * 0.025::DOUBLE / 1000000 AS DOUBLE))::DOUBLE AS cc,
  format('{{:.4f}}', CAST(reasoning_tokens * 2.0::DOUBLE / 1000000 AS DOUBLE))::DOUBLE AS rc, format('{{:.4f}}', CAST(output_tokens * 2.0::DOUBLE / 1000000 AS DOUBLE))::DOUBLE AS oc,
  format('{{:.4f}}', CAST(input_tokens * 0.25::DOUBLE / 1000000 + output_tokens * 2.0::DOUBLE / 1000000 AS DOUBLE))::DOUBLE AS wi FROM p),
d AS (SELECT *, CASE WHEN memo_hit THEN 0.0::DOUBLE ELSE format('{{:.4f}}', CAST(ic + cc + rc + oc AS DOUBLE))::DOUBLE END AS tot,
  CASE WHEN memo_hit THEN 'memo_hit' WHEN ct > 0 THEN 'hit' ELSE 'miss' END AS cs FROM c)"""


def _run_sql(run: int) -> str:
    return f"""r{run} AS (SELECT rid, f1 t1, f2 t2, f3 t3, CASE WHEN rid % {3 + run} = 0 THEN 'Z' ELSE lower(f1) END p1, CASE WHEN rid % {5 - run} = 0 THEN NULL ELSE f2 END p2,
      CASE WHEN rid % 2 = {run} THEN 'O' ELSE f3 END p3 FROM base),
    l{run} AS (SELECT 'f1' AS field, lower(t1) = lower(p1) AS eq, t1 IS NULL AS tn_, p1 IS NULL AS pn FROM r{run} UNION ALL SELECT 'f2', t2 = p2, t2 IS NULL, p2 IS NULL FROM r{run}
      UNION ALL SELECT 'f3', t3 = p3, t3 IS NULL, p3 IS NULL FROM r{run}),
    c{run} AS (SELECT field, count(*) FILTER (coalesce(eq, false)) AS tp, count(*) FILTER (NOT pn AND NOT coalesce(eq, false)) AS fp,
      count(*) FILTER (NOT tn_ AND NOT coalesce(eq, false)) AS fn, count(*) AS n FROM l{run} GROUP BY field),
    m{run} AS (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS f1 FROM c{run}),
    s{run} AS (SELECT sum(tp) / sum(tp + fp) AS precision, sum(tp) / sum(tp + fn) AS recall, 2.0::DOUBLE * sum(tp) / sum(2 * tp + fp + fn) AS f1, avg(f1) AS macro FROM m{run})"""


_RUNS = f"""WITH base AS (SELECT rid, min(f1) AS f1, min(f2) AS f2, min(f3) AS f3 FROM ({plain(RUN_TRUTH)}) GROUP BY rid), {_run_sql(0)}, {_run_sql(1)}"""
_REL = f"""WITH f AS ({plain(FEATURES)}), a AS (SELECT *, lower(raw_data_type) AS t, trim(CASE WHEN human = 'No dataset' THEN 'X' ELSE human END) AS hu,
  CASE WHEN data_type_primary IN ('abundance', 'density') THEN 3 WHEN data_type_primary IN ('distribution', 'presence-absence') THEN 2
    WHEN data_type_primary IN ('genetic_analysis', 'presence-only', 'species_richness') THEN 1 ELSE 0 END AS pr FROM f),
b AS (SELECT *, CASE WHEN t IN ('other', 'unknown') THEN 0 WHEN t = 'genetic analysis' THEN 1 WHEN t = 'relative abundance' THEN 1 WHEN t IN ('ebv genetic analysis', 'abundance') THEN 3
    WHEN t = 'presence-absence' THEN 2 WHEN t = 'presence only' THEN 1 ELSE pr END AS d,
  CASE WHEN temp_range_i IS NULL THEN 0 WHEN temp_range_f - temp_range_i + 1 >= 12 THEN 3 WHEN temp_range_f - temp_range_i + 1 >= 3 THEN 2 ELSE 1 END AS m,
  CASE WHEN spatial_range_km2 IS NULL THEN 0 WHEN spatial_range_km2 > 15000 THEN 3 WHEN spatial_range_km2 >= 5000 THEN 2 ELSE 1 END AS s FROM a),
c AS (SELECT *, CASE WHEN d = m OR d = s THEN d WHEN m = s THEN m WHEN d = 3 AND least(m, s) = 0 THEN 1 ELSE least(d, greatest(m, s)) END AS v FROM b),
e AS (SELECT *, CASE WHEN multispecies OR coalesce(lower(threatened_species) IN ('true', '1', 'yes'), false) THEN least(v + 1, 3) ELSE v END AS fin FROM c),
r AS (SELECT id, ['X', 'L', 'M', 'H'][d + 1] AS mc_data_type, ['X', 'L', 'M', 'H'][m + 1] AS mc_temporal, ['X', 'L', 'M', 'H'][s + 1] AS mc_spatial,
  ['X', 'L', 'M', 'H'][v + 1] AS mc_relevance, ['X', 'L', 'M', 'H'][fin + 1] AS pred_relevance, hu AS human FROM e)"""


def _classes_sql(where: str, truth_only: bool) -> str:
    seen = "tp + fn > 0" if truth_only else "tp + fn > 0 OR fp > 0"
    return f"""{_REL}, k AS (SELECT unnest(['H', 'M', 'L', 'X']) AS label), q AS (SELECT label, count(*) FILTER (human = label AND pred_relevance = label) AS tp,
      count(*) FILTER (human <> label AND pred_relevance = label) AS fp, count(*) FILTER (human = label AND pred_relevance <> label) AS fn FROM k, r WHERE {where} GROUP BY label),
    cls AS (SELECT label, tp, fp, fn, tp + fn AS support, {seen} AS present, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
      coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM q)"""


QUERIES = {f.__name__: f for f in (
    manifest_build, manifest_coverage, coverage_by_source, dataset_kpis, dup_keys, record_index_merge, mapping_enrichment, method_summary,
    article_mapping, pdf_fallback_chain, doi_normalize, doi_variants, catalogue_lookup, citation_edges, observation_summary, upsert_latest,
    upsert_two_columns, delete_cascade, pending_documents, sha_collisions, embedding_cache_diff, cost_accounting, run_kpis, fill_rate,
    cost_by_source, extraction_csv_rows, run_records_status, run_compare, run_trend_pivot, run_overall_deltas, relevance_rules,
    confusion_matrix, class_report, class_report_binary, class_report_macro, mc_audit, mc_audit_mismatches, relevance_delta)}

_AUDIT = " UNION ALL ".join(f"""SELECT '{g}' AS gt_column, '{c}' AS computed_column, count(*) AS compared, count(*) FILTER ({g} = {c}) AS matches,
  count(*) FILTER ({g} <> {c}) AS mismatches, round_even(count(*) FILTER ({g} = {c}) / count(*), 3) AS accuracy FROM r""" for g, c in (
    ("human", "pred_relevance"), ("human", "mc_relevance"), ("mc_data_type", "mc_spatial")))

ORACLE = {
    "manifest_build": _M + " SELECT * FROM m",
    "manifest_coverage": _M + f""", files AS (SELECT DISTINCT 'data/pdfs/' || replace(downloaded_pdf_path, '\\', '/') AS path FROM ({plain(PDFS)}) WHERE downloaded_pdf_path LIKE '%5.pdf')
      SELECT count(*) AS total, count(pdf_local_path) AS with_pdf_local_path, count(path) AS pdf_on_disk, count(pdf_local_path) - count(path) AS missing_from_disk,
      count(*) - count(pdf_local_path) AS no_pdf_path FROM m LEFT JOIN files ON path = pdf_local_path""",
    "coverage_by_source": f"""WITH s AS (SELECT * FROM ({plain(SHEET)}) JOIN ({plain(RAW)}) USING (id)), g AS (SELECT source, count(*) AS total_records, count(*) FILTER (valid_yn = 'yes') AS valid_records,
      count(full_text) AS has_abstract, count(*) FILTER (contains(source_url, 'doi.org/')) AS has_doi, count(cited_article_doi) AS has_cited_articles FROM s GROUP BY source)
      SELECT *, format('{{:.1f}}%', 100.0::DOUBLE * has_abstract / total_records) AS abstract_pct, format('{{:.1f}}%', 100.0::DOUBLE * has_doi / total_records) AS doi_pct FROM g""",
    "dataset_kpis": f"""SELECT count(*) AS records, count(*) FILTER (source = 'dryad') AS from_dryad, count(*) FILTER (source = 'zenodo') AS from_zenodo,
      count(*) FILTER (is_oa = 1) AS open_access, count(pdf_url) AS has_pdf_url FROM ({plain(SHEET)})""",
    "dup_keys": f"SELECT record_id, count(*) AS n FROM ({plain(PDFS)}) GROUP BY 1 HAVING count(*) > 1",
    "record_index_merge": _M + """ SELECT CAST(m.gt_record_id AS VARCHAR) AS id, m.title, coalesce(m.source, s.source) AS source, coalesce(m.pdf_url, s.pdf_url) AS pdf_url,
      coalesce(CAST(m.is_oa AS VARCHAR), CAST(s.is_oa AS VARCHAR)) AS is_oa, s.valid_yn, coalesce(m.article_doi, m.source_doi, s.source_url) AS doi FROM m JOIN sheet s ON s.id = m.gt_record_id""",
    "mapping_enrichment": f"""WITH s AS ({plain(SHEET)}) SELECT c_custkey AS id, cited_article_doi AS article_doi, 'mapping' AS source FROM customer LEFT JOIN s ON id = c_custkey
      UNION ALL SELECT id, cited_article_doi, source FROM s WHERE id NOT IN (SELECT c_custkey FROM customer)""",
    "method_summary": "SELECT n_nationkey AS key, coalesce(r_name, n_name) AS value FROM nation LEFT JOIN region ON r_regionkey = n_nationkey",
    "article_mapping": f"""WITH s AS (SELECT id, CASE WHEN id % 7 = 0 THEN '10.5281/zenodo.1' WHEN id % 11 = 0 THEN 'a;b' ELSE {_from('cited_article_doi')} END AS article_doi FROM ({plain(SHEET)}))
      SELECT * FROM s WHERE article_doi IS NOT NULL AND article_doi NOT LIKE '10.5281/zenodo%' AND article_doi NOT LIKE '%;%'""",
    "pdf_fallback_chain": f"""WITH s AS (SELECT *, lower({_from('cited_article_doi')}) AS doi FROM ({plain(SHEET)}))
      SELECT id, CASE WHEN pdf_url IS NOT NULL THEN 'work' WHEN is_oa = 1 THEN 'open_access' WHEN doi LIKE '10.1111/%' OR doi LIKE '10.1038/%' THEN 'publisher_guess' END AS pdf_strategy,
      CASE WHEN pdf_url IS NOT NULL THEN pdf_url WHEN is_oa = 1 THEN source_url WHEN doi LIKE '10.1111/%' THEN 'https://onlinelibrary.wiley.com/doi/pdfdirect/' || doi
        WHEN doi LIKE '10.1038/%' THEN 'https://www.nature.com/articles/' || substr(doi, 9) || '.pdf' END AS pdf_source FROM s""",
    "doi_normalize": f"""WITH d AS ({plain(DOIS)}), b AS (SELECT *, {_BARE.format(x='raw')} AS bare FROM d) SELECT page_id, bare, lower(bare) AS doi,
      CASE WHEN regexp_matches(bare, '^10\\.[0-9]{{4,}}') THEN bare END AS extracted, replace(bare, '/', '_') AS stem,
      replace(replace(replace(bare, '/', '_'), ':', '_'), ' ', '_') AS safe, contains(lower(raw), 'doi.org/') AS mentions, true AS same_upper,
      CASE WHEN lower(bare) LIKE '10.1007/%' THEN 'https://link.springer.com/content/pdf/' || lower(bare) || '.pdf' END AS pdf FROM b""",
    "doi_variants": f"""WITH d AS ({plain(DOIS)}), b AS (SELECT page_id, lower({_BARE.format(x='raw')}) AS bare FROM d),
      v AS (SELECT page_id, [bare, 'https://doi.org/' || bare, 'doi:' || bare, url_decode(bare), replace(replace(url_encode(bare), '%2F', '/'), '%3A', ':')] AS x FROM b WHERE bare <> ''),
      k AS (SELECT page_id, list_filter(x, lambda s, i: list_position(x, s) = i) AS x FROM v)
      SELECT page_id, CAST(r.i - 1 AS INT) AS pos, x[r.i] AS variant FROM k, range(1, len(x) + 1) r(i)""",
    "extraction_csv_rows": _USAGE + """ SELECT CAST(gt_record_id AS VARCHAR) AS gt_record_id, status, CASE WHEN NOT ok THEN '' WHEN tot > 0 AND tot < 0.001 THEN CAST(round(tot * 10000) AS INT) || '.0E-4'
      ELSE CAST(tot AS VARCHAR) END AS cost_usd, CASE WHEN ok THEN f_text ELSE '' END AS species, coalesce(CASE WHEN ok THEN CAST(f_number AS VARCHAR) END, '') AS temp_range_i,
      coalesce(CASE WHEN ok THEN f_flag END, '') AS time_series FROM d""",
    "catalogue_lookup": f"""WITH s AS (SELECT id, lower({_BARE.format(x='cited_article_doi')}) AS d FROM ({plain(SHEET)}))
      SELECT id, c_name AS found_c_name FROM s LEFT JOIN customer ON d = '10.1111/mec.' || c_custkey""",
    "citation_edges": """SELECT CAST(s_suppkey AS VARCHAR) AS paper_id, s_name AS name, 'citing' AS kind FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey = 7)
      UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name, 'reference' FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 7)""",
    "observation_summary": """SELECT p_type AS group_name, count(DISTINCT l_partkey) AS taxa_count, count(*) AS obs_count FROM lineitem JOIN part ON l_partkey = p_partkey
      WHERE year(l_shipdate) BETWEEN 1996 AND 2000 GROUP BY 1""",
    "upsert_latest": _LATEST + " SELECT * FROM upd UNION ALL SELECT * FROM cur WHERE work_id NOT IN (SELECT work_id FROM upd)",
    "upsert_two_columns": _LATEST + """ SELECT coalesce(c.work_id, u.work_id) AS work_id, coalesce(u.status, c.status) AS status, CASE WHEN c.work_id IS NULL THEN u.note ELSE c.note END AS note,
      coalesce(u.ord, c.ord) AS ord FROM cur c FULL JOIN upd u ON c.work_id = u.work_id""",
    "delete_cascade": _LATEST + """ SELECT 'documents' AS name, CAST(work_id AS BIGINT) AS work_id, 0 AS part FROM cur WHERE work_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL
      SELECT 'chunks', l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
    "pending_documents": _LATEST + " SELECT work_id FROM cur WHERE work_id NOT IN (SELECT work_id FROM upd WHERE status = 'INDEXED')",
    "sha_collisions": """SELECT sha256(text) AS pdf_sha256, count(*) AS n, min(doc_id) AS first_work_id, max(doc_id) AS last_work_id FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "embedding_cache_diff": """SELECT CAST(doc_id AS VARCHAR) AS chunk_id, sha256(text) AS text_hash,
      coalesce(label % 4 <> 1 AND (label % 3 <> 0 OR upper(text) = text), false) AS hit, CASE WHEN label % 4 <> 1 AND (label % 3 <> 0 OR upper(text) = text) THEN CAST(len(embedding) AS INT) END AS dims
      FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
    "cost_accounting": _USAGE + """ SELECT source, CASE WHEN ok THEN cs ELSE 'unknown' END AS cache_status, count(*) AS n, round(sum(CASE WHEN ok THEN tot END), 4) AS used, round(sum(CASE WHEN ok THEN wi END), 4) AS value,
      round(sum(CASE WHEN ok THEN format('{:.4f}', CAST(wi - tot AS DOUBLE))::DOUBLE END), 4) AS savings, CAST(sum(CASE WHEN ok THEN greatest(input_tokens - ct, 0) END) AS BIGINT) AS tokens_used FROM d GROUP BY ALL""",
    "run_kpis": _USAGE + """ SELECT run, count(*) AS total_records, count(*) FILTER (ok) AS success_count, count(*) FILTER (status = 'skipped') AS skipped_count, count(*) FILTER (status = 'error') AS error_count,
      count(*) FILTER (ok) AS output_count, count(*) FILTER (ok AND cs <> 'miss') AS cache_hits, count(*) FILTER (ok AND cs = 'miss') AS cache_misses,
      CAST(sum(greatest(input_tokens - ct, 0)) FILTER (ok) AS BIGINT) AS input_tokens_used, CAST(sum(input_tokens) FILTER (ok) AS BIGINT) AS input_tokens_value, CAST(sum(ct) FILTER (ok) AS BIGINT) AS cached_tokens,
      round(sum(tot) FILTER (ok), 4) AS cost_used_usd, round(sum(wi) FILTER (ok), 4) AS cost_value_usd, round(avg(wi) FILTER (ok) + 1e-9, 4) AS avg_cost_value_usd,
      avg((trim(f_text) <> '')::INT + (f_number IS NOT NULL)::INT + (f_flag IS NOT NULL)::INT) FILTER (ok) AS avg_populated_fields,
      round(sum(wi) FILTER (ok) - sum(tot) FILTER (ok), 4) AS cache_savings_usd FROM d GROUP BY run""",
    "fill_rate": _USAGE + " ".join(f"""{'UNION ALL' if i else ''} SELECT '{f}' AS field, count(*) FILTER ({c}) AS records_with_value, count(*) AS success_records,
      round_even(count(*) FILTER ({c}) / count(*), 3) AS fill_rate FROM d WHERE ok""" for i, (f, c) in enumerate((
        ("species", "trim(f_text) <> ''"), ("temp_range_i", "f_number IS NOT NULL"), ("time_series", "f_flag IS NOT NULL")))),
    "cost_by_source": _USAGE + """ SELECT source, count(*) AS records, round(sum(tot) + 1e-9, 4) AS total_cost, round(avg(tot) + 1e-9, 4) AS avg_cost, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
      CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(avg(input_tokens) + 1e-9, 4) AS avg_input_tokens, round(avg(output_tokens) + 1e-9, 4) AS avg_output_tokens FROM d WHERE ok GROUP BY source""",
    "run_records_status": _M + """ SELECT gt_record_id, coalesce(article_doi, source_doi, CAST(gt_record_id AS VARCHAR)) AS record_id,
      CASE WHEN abstract IS NULL THEN 'skipped' WHEN gt_record_id % 10 = 1 OR o_orderstatus = 'P' THEN 'error' ELSE 'success' END AS status,
      CASE WHEN abstract IS NULL THEN 'Missing abstract.' WHEN gt_record_id % 10 = 1 THEN 'Timeout: x' WHEN o_orderstatus = 'P' THEN 'no output' END AS error_message,
      CASE WHEN abstract IS NOT NULL AND NOT (gt_record_id % 10 = 1 OR o_orderstatus = 'P') THEN 'abstract_text' END AS extraction_method FROM m JOIN orders ON o_orderkey = gt_record_id""",
    "run_compare": _RUNS + """ SELECT a.field, a.n AS n_a, round_even(b.precision - a.precision, 3) AS delta_precision, round_even(b.recall - a.recall, 3) AS delta_recall, round_even(b.f1 - a.f1, 3) AS delta_f1
      FROM m0 a JOIN m1 b ON a.field = b.field""",
    "run_trend_pivot": _RUNS + " UNION ALL ".join(f""" SELECT '2026010{i + 1}_120000' AS timestamp, (SELECT round(f1, 6) FROM s{i}) AS micro, (SELECT round(macro, 6) FROM s{i}) AS macro,
      round(max(f1) FILTER (field = 'f1'), 6) AS f1, round(max(m{i}.f1) FILTER (field = 'f2'), 6) AS f2, round(max(m{i}.f1) FILTER (field = 'f3'), 6) AS f3 FROM m{i}""" for i in (0, 1)),
    "run_overall_deltas": _RUNS + """ SELECT round_even(b.precision - a.precision, 3) AS delta_micro_precision, round_even(b.recall - a.recall, 3) AS delta_micro_recall,
      round_even(b.f1 - a.f1, 3) AS delta_micro_f1, round_even(b.macro - a.macro, 3) AS delta_macro_f1,
      CASE WHEN abs(b.f1 - b.macro) < 0.05 THEN 'uniform' WHEN b.f1 > b.macro THEN 'common_fields_better' ELSE 'rare_fields_better' END AS balance FROM s0 a, s1 b""",
    "relevance_rules": _REL + " SELECT * FROM r",
    "confusion_matrix": _REL + " SELECT human AS true_label, " + ", ".join(f"count(*) FILTER (pred_relevance = '{x}') AS pred_{x}" for x in "HMLX") + " FROM r GROUP BY human",
    "class_report": _classes_sql("true", False) + " SELECT * FROM cls",
    "class_report_binary": _REL + """, b2 AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn
      FROM (SELECT human IN ('H', 'M') AS t, pred_relevance IN ('H', 'M') AS p FROM r)) SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS f1 FROM b2""",
    "class_report_macro": _classes_sql("human <> 'X'", True) + " SELECT avg(f1) FILTER (present) AS macro_f1_present, avg(f1) AS macro_f1_all FROM cls",
    "mc_audit": _REL + " " + _AUDIT,
    "mc_audit_mismatches": _REL + " " + " UNION ALL ".join(f"SELECT id, '{g}' AS gt_column, '{c}' AS computed_column, {g} AS gt_value, {c} AS computed_value FROM r WHERE {g} <> {c}" for g, c in (
        ("human", "pred_relevance"), ("mc_data_type", "mc_spatial"))),
    "relevance_delta": _REL + """ SELECT count(*) AS n, count(*) FILTER (pred_relevance = mc_relevance) AS same, count(*) FILTER (pred_relevance = human) AS a_correct, count(*) FILTER (mc_relevance = human) AS b_correct,
      count(*) FILTER (pred_relevance = human AND mc_relevance <> human) AS degraded, count(*) FILTER (pred_relevance <> human AND mc_relevance = human) AS improved FROM r""",
}
