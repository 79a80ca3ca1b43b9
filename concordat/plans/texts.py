"""Text, section, chunk, grounding, vector and work-record queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from concordat.functions import sections as sec
from concordat.functions.text import clean_markup
from concordat.operators import chunking as ch
from concordat.operators import grounding as gr
from concordat.operators import sections as so
from concordat.operators import vectors as vx
from concordat.operators import works as wk
from concordat.plans.base import derived, plain, table
from concordat.session import ensure_checkpoint_dir
from concordat.sources import readers, tei

# ---- Headings, flags, sentences --------------------------------------------

HEADINGS = """SELECT page_id, CASE page_id % 16 WHEN 0 THEN '1. Introduction' WHEN 1 THEN '2.1 Materials and Methods' WHEN 2 THEN 'IV. Results' WHEN 3 THEN ' Results & Discussion '
  WHEN 4 THEN '(a) Study area' WHEN 5 THEN 'Mix design' WHEN 6 THEN 'Appendix A: Supplementary Methods' WHEN 7 THEN 'Acknowledgements' WHEN 8 THEN 'Data availability statement'
  WHEN 9 THEN 'Literature cited' WHEN 10 THEN 'A. Conclusions' WHEN 11 THEN 'Résumé' WHEN 12 THEN 'Future directions' WHEN 13 THEN split_part(split_part(html, '<h1>', 2), '</h1>', 1)
  WHEN 14 THEN 'DATA COLLECTION*' ELSE url END AS heading FROM {pages}"""


def _headings(spark, sf):
    return derived(spark, sf, HEADINGS)


def heading_classify(spark, sf):
    return _headings(spark, sf).select("page_id", sec.normalize_heading("heading").alias("normalized"), sec.section_type("heading").alias("section_type"),
                                       sec.is_likely_heading("heading").alias("likely"), sec.section_path("heading", F.lit("Top")).alias("path"))


def content_flags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sec.content_flags("text").alias("f")).select("doc_id", "f.*")


def sentence_split(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(sec.sentences("text")).alias("pos", "sentence"))
    return rows.select("doc_id", "pos", F.length("sentence").alias("n_chars"), F.sha2("sentence", 256).alias("sha"))


def sentence_split_at_sign(spark, sf):
    """The quirk-compatible split: every @ comes back as a full stop."""
    rows = table(spark, sf, "documents").select("doc_id", sec.sentences("text", literal_at_sign=True).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n"), F.sha2(F.array_join("s", "|"), 256).alias("sha"))


def markup_clean(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(clean_markup("html"), 256).alias("sha"), F.length(clean_markup("html")).alias("n"))


# ---- Documents with sections -----------------------------------------------

# Paragraph k of a document becomes a section; the first is the abstract.
TITLES = ("Introduction", "2. Materials and Methods", "Study area", "Results", "Field notes", "Discussion", "References", "Methods of sampling")


def _tail(column):
    """All elements but the first."""
    return F.slice(column, F.lit(2), F.greatest(F.size(column) - 1, F.lit(0)))


def _documents(spark, sf):
    titles = F.array(*[F.lit(t) for t in TITLES])
    docs = table(spark, sf, "documents").select(F.concat(F.lit("W"), "doc_id").alias("work_id"), "lang", F.split("text", "\n").alias("p"))
    title = lambda i: F.element_at(titles, (i % len(TITLES)) + 1)
    sections = F.transform(_tail("p"), lambda t, i: F.struct(
        F.concat(F.col("work_id"), F.lit("_sec_"), (i + 1).cast("string")).alias("section_id"), title(i).alias("title"),
        F.when(i % 3 == 0, 1).otherwise(2).alias("level"), F.lit("").alias("path"), t.alias("text"),
        F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end")))
    return docs.select("work_id", F.col("lang").alias("language"), F.get("p", F.lit(0)).alias("abstract"), so.with_lineage(sections).alias("sections"))


CHUNKS = ch.ChunkConfig(target_tokens=60, max_tokens=80, overlap_tokens=20)


def _chunks(spark, sf):
    return ch.chunk_documents(_documents(spark, sf), CHUNKS)


def chunk_documents(spark, sf):
    return ch.to_payload(_chunks(spark, sf)).select("chunk_id", "section_id", "section_type", "chunk_index_in_section", "token_count", "char_start",
                                                    "char_end", F.sha2("text", 256).alias("sha"), "is_abstract", "has_equation")


def chunk_numbering(spark, sf):
    """Per document: chunk numbers run from 1 without gaps, no text of a section is lost."""
    return _chunks(spark, sf).groupBy("work_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("bigint")).alias("last"),
        F.countDistinct("section_id").alias("sections"))


def chunk_short_texts(spark, sf):
    """Texts within the limit come back as one untouched chunk."""
    rows = ch.chunk_text(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "text")
    return rows.select("conv_id", "turn", "chunk_index", "char_start", "char_end", "token_count", F.sha2("text", 256).alias("sha"))


def chunk_stats(spark, sf):
    from concordat.operators.stability import describe

    chunks = ch.chunk_text(table(spark, sf, "documents").select("doc_id", "lang", "text"), "text", CHUNKS)
    ensure_checkpoint_dir(spark)
    # Texts are cut once; what is described several times over are two short columns.
    return describe(chunks.select("lang", "token_count").checkpoint(), "token_count", ["lang"])


def chunk_work_metadata(spark, sf):
    """Bibliographic columns on chunks, title from the work when it has one."""
    works = table(spark, sf, "documents").select(F.concat(F.lit("W"), "doc_id").alias("work_id"), F.concat(F.lit("10.1/"), "doc_id").alias("doi"),
                                                 F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("title"))
    rows = ch.chunk_documents(_documents(spark, sf), works=works)
    return rows.groupBy("work_id", "doi", "title").agg(F.count(F.lit(1)).alias("n"))


def section_select(spark, sf):
    picked = _documents(spark, sf).select("work_id", F.posexplode(so.relevant_sections(F.col("sections"))).alias("pos", "s"))
    return picked.select("work_id", "pos", F.col("s.section_id").alias("section_id"), F.col("s.title").alias("title"), F.col("s.path").alias("path"))


def section_prompt(spark, sf):
    out = so.sections_mode(_documents(spark, sf))
    return out.select("work_id", F.length("prompt_text").alias("n_chars"), F.sha2("prompt_text", 256).alias("sha"))


def _escape(c):
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def tei_sections(spark, sf):
    """Documents written as TEI and read back: two nested levels, pages from coordinates."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("W"), "doc_id").alias("work_id"), "doc_id", "lang", "source", F.split("text", "\n").alias("p"))
    inner = F.array_join(F.transform(_tail("p"), lambda t, i: F.concat(
        F.lit('<div coords="'), (i + 2).cast("string"), F.lit(",1,1;"), (i + 3).cast("string"), F.lit(',2,2"><head>Part '), (i + 1).cast("string"),
        F.lit("</head><p>"), _escape(t), F.lit("</p></div>"))), "")
    xml = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>'), F.col("source"), F.lit(
        "</title></titleStmt></fileDesc><profileDesc><abstract><p>"), _escape(F.get("p", F.lit(0))), F.lit("</p></abstract><textClass><keywords><term> "),
        F.col("source"), F.lit('</term></keywords></textClass></profileDesc></teiHeader><text xml:lang="'), F.col("lang"),
        F.lit('"><body><div><head>Main</head><p>intro</p>'), inner, F.lit("</div></body></text></TEI>"))
    # Control characters other than line breaks are not allowed in XML text.
    parsed = tei.parse_documents(docs.select("work_id", F.regexp_replace(xml, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ").alias("xml")), "xml")
    rows = parsed.select("work_id", "title", "language", F.array_join("keywords", "|").alias("keywords"), F.explode("sections").alias("s"))
    return rows.select("work_id", "title", "language", "keywords", F.col("s.section_id").alias("section_id"), F.col("s.level").alias("level"),
                       F.col("s.path").alias("path"), F.col("s.page_start").alias("page_start"), F.col("s.page_end").alias("page_end"),
                       F.sha2("s.text", 256).alias("sha"))


# ---- Grounding -------------------------------------------------------------

CLAIMS = """SELECT doc_id, text, CASE lang WHEN 'en' THEN 'density' WHEN 'fr' THEN 'traits' ELSE 'abundance' END AS gt_type, CASE WHEN n_chars % 3 = 0 THEN NULL WHEN n_chars % 3 = 1 THEN 'Abundance' ELSE 'traits' END AS pred_type
  FROM {documents}"""


def grounding_table(spark, sf):
    """Claims against the whole text: characters 3 to 11 as a name with a made-up one, cue phrases."""
    docs = derived(spark, sf, CLAIMS)
    listed = docs.select("doc_id", "text", F.array(F.concat(F.substring("text", 3, 9), F.lit(" zzqq"))).alias("gt_species"),
                         F.array(F.concat(F.lit(" "), F.substring("text", 3, 9), F.lit(" - ZZqq")), F.lit("Canis lupus")).alias("pred_species"),
                         F.array("gt_type").alias("gt_type"), F.when(F.col("pred_type").isNotNull(), F.array("pred_type")).alias("pred_type"))
    return gr.comparison_table(listed, "doc_id", "text", {"species": ("gt_species", "pred_species"), "data_type": ("gt_type", "pred_type")})


def grounding_crosstab(spark, sf):
    return gr.crosstab(grounding_table(spark, sf), "field", "bucket", ["match", "gt_only", "pred_only", "overlap_mismatch"])


def grounding_benchmark(spark, sf):
    """Does a benchmark item's first sentence occur in the item: explicit for every item with letters."""
    items = table(spark, sf, "benchmark").select("item_id", gr.keyed_sentences(F.col("text")).alias("s"))
    first = F.get("s", F.lit(0))["sentence"]
    return items.select("item_id", gr.ground_species(first, F.col("s")).alias("g"), first.alias("first")).select(
        "item_id", "g.support_type", (F.col("g.quote") == F.col("first")).alias("same_quote"))


# ---- Vectors ---------------------------------------------------------------


def _query_vector(spark, sf):
    return list(table(spark, sf, "embeddings").filter("vec_id = 0").first()["embedding"])


def vector_topk(spark, sf):
    found = vx.search(table(spark, sf, "embeddings"), _query_vector(spark, sf), id_column="vec_id", limit=10)
    return found.select("vec_id", F.round("score", 5).alias("score"))


FLAGGED = """SELECT vec_id, embedding, label, label % 5 = 0 AS is_references, '10.1/' || label AS doi, CAST(2000 + vec_id % 25 AS INT) AS publication_year,
  CASE label % 3 WHEN 0 THEN 'METHODS' WHEN 1 THEN 'RESULTS' ELSE 'INTRO' END AS section_type FROM {embeddings}"""


def vector_topk_filtered(spark, sf):
    rows = derived(spark, sf, FLAGGED).withColumn("author_orcids", F.array(F.lit("a"), F.col("section_type")))
    where = vx.metadata_filter(years=(2005, 2020), section_types=["METHODS", "RESULTS"], author_orcid="a")
    found = vx.search(rows, _query_vector(spark, sf), id_column="vec_id", limit=7, where=where)
    return found.select("vec_id", "section_type", "publication_year", F.round("score", 5).alias("score"))


def vector_distances(spark, sf):
    """All three distances of every vector to one query."""
    q = _query_vector(spark, sf)
    scored = table(spark, sf, "embeddings").select("vec_id", vx.similarities("embedding", q).alias("s"))
    return scored.select("vec_id", *[F.round(F.col("s")[d], 4).alias(d) for d in vx.DISTANCES])


def vector_stats(spark, sf):
    return vx.collection_stats(table(spark, sf, "embeddings"), "papers_chunks").select(
        "collection_name", "points_count", "vectors_count", "min_dimensions", "max_dimensions", "status")


def vector_point_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", vx.point_id(F.concat(F.lit("W"), "doc_id", F.lit("_chunk_1"))).cast("string").alias("point_id"))


# ---- Work records ----------------------------------------------------------


def inverted_index_roundtrip(spark, sf):
    docs = table(spark, sf, "documents").withColumn("inverted", wk.invert_text(F.regexp_replace("text", r"\s+", " ")))
    return docs.select("doc_id", F.size("inverted").alias("n_words"), F.sha2(wk.abstract_text(F.col("inverted")), 256).alias("sha"))


WORK_JSON = """SELECT o_orderkey, '{{"id": "W' || o_orderkey || '", "doi": "10.1/' || o_custkey || '", "title": "T ' || o_orderpriority || '", "publication_date": "' ||
  CASE WHEN o_orderkey % 7 = 0 THEN 'soon' ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END || '", "type": "' || CASE WHEN o_orderkey % 5 = 0 THEN 'Preprint' ELSE 'article' END ||
  '", "authorships": [{{"author": {{"display_name": "C' || o_custkey || '", "orcid": "https://orcid.org/0-' || o_custkey || '"}}, "institutions": [{{"ror": "r2"}}, {{"ror": null}}]}}, {{"author": {{"display_name": "Z"}}, "institutions": [{{"ror": "r1"}}, {{"ror": "r2"}}]}}],' ||
  ' "open_access": {{"is_oa": ' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'null' END || ', "oa_status": "gold"}}, "best_oa_location": {{"pdf_url": "https://p/' || o_orderkey || '"}}, "topics": [{{"id": "T1"}}, {{"id": ""}}]}}' AS value FROM {orders}"""


def work_records(spark, sf):
    """Nested work JSON flattened."""
    w = wk.parse_works(derived(spark, sf, WORK_JSON))
    a = F.get("authors", F.lit(0))
    return w.select("o_orderkey", "openalex_id", "doi", "title", F.date_format("publication_date", "yyyy-MM-dd").alias("published"), a["name"].alias("first_author"),
                    a["orcid"].alias("orcid"), "is_oa", "pdf_url", "is_preprint", F.array_join("topics", "|").alias("topics"), F.array_join("institutions", "|").alias("rors"))


def oa_locations(spark, sf):
    """Open-access article structs: best address, all addresses, status."""
    o = table(spark, sf, "orders")
    url = lambda tail: F.concat(F.lit("https://x/"), F.col("o_custkey").cast("string"), F.lit(tail))
    loc = lambda pdf, page: F.struct(pdf.alias("url_for_pdf"), page.alias("url"))
    null = F.lit(None).cast("string")
    best = loc(F.when(F.col("o_orderkey") % 3 == 0, url("/a.pdf")), url("/page"))
    article = F.struct((F.col("o_orderkey") % 2 == 0).alias("is_oa"), F.lit("green").alias("oa_status"), F.lit(None).cast("boolean").alias("has_repository_copy"),
                       F.lit(True).alias("journal_is_oa"), F.lit(None).cast("boolean").alias("journal_is_in_doaj"), best.alias("best_oa_location"),
                       F.array(best, loc(null, url("/b.pdf")), loc(url("/b.pdf"), url("/c"))).alias("oa_locations"))
    rows = o.select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, article).alias("a"))
    s = wk.oa_status(F.col("a"))
    return rows.select("o_orderkey", wk.best_pdf_url(F.col("a")).alias("best"), F.array_join(wk.all_pdf_urls(F.col("a")), "|").alias("urls"),
                       s["is_oa"].alias("is_oa"), s["has_repository_copy"].alias("repo"), s["journal_is_oa"].alias("journal"))


def jsonl_props_extract(spark, sf):
    """JSON text properties: typed extraction and a map-of-records explode."""
    ev = table(spark, sf, "events")
    one = ev.select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", F.col("p.k").alias("k"))
    wrapped = ev.select(F.concat(F.lit('{"records": {"'), "event_id", F.lit('": {"title": "'), "event_type", F.lit(
        '", "source_url": "https://doi.org/10.1/'), "user_id", F.lit('"}}}')).alias("value"))
    legacy = readers.legacy_records(wrapped).select(F.col("id").cast("bigint").alias("event_id"), "title", "doi")
    # A row for every event on both sides: the sizes of the files say little of them, so neither may be broadcast.
    return one.join(legacy.hint("merge"), "event_id")


def metadata_scroll(spark, sf):
    """Metadata-only listing, the whole of it."""
    rows = _chunks(spark, sf).select("work_id", "section_title", "section_type", "has_equation")
    return vx.scroll(rows, section_type="METHODS", title_contains="materials").groupBy("section_title").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    heading_classify, content_flags, sentence_split, sentence_split_at_sign, markup_clean, chunk_documents, chunk_numbering, chunk_short_texts,
    chunk_stats, chunk_work_metadata, section_select, section_prompt, tei_sections, grounding_table, grounding_crosstab, grounding_benchmark,
    vector_topk, vector_topk_filtered, vector_distances, vector_stats, vector_point_ids, inverted_index_roundtrip, work_records, oa_locations,
    jsonl_props_extract, metadata_scroll)}

# ---- Oracle ----------------------------------------------------------------

_H = "trim(heading)"
for _pattern, _flags in ((r"^(?:[0-9]+\.)*[0-9]+\.?\s+", ""), (r"^[IVXLCDM]+\.?\s+", "i"), (r"^[A-Z]\.?\s+", ""), (r"^\([a-z0-9]+\)\s+", "i"),
                         (r"[^\p{L}\p{N}_\s&+\-]", "g"), (r"\s+", "g")):
    _H = f"regexp_replace({_H}, '{_pattern}', '{' ' if _pattern == chr(92) + 's+' else ''}', '{_flags}')" if _flags else f"regexp_replace({_H}, '{_pattern}', '')"
_H = f"trim(lower({_H}))"
_TYPES = " ".join(f"WHEN regexp_full_match(h, '{'|'.join(p)}') THEN '{name}'" for name, p in sec.SECTION_PATTERNS.items())


def _sentences_sql(mark: str) -> str:
    t = "text"
    for a in sec.ABBREVIATIONS:
        t = f"replace({t}, '{a}', '{a.replace('.', mark)}')"
    cut = f"string_split(regexp_replace({t}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_transform(list_filter({cut}, lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g')) <> ''), lambda s: replace(regexp_replace(s, '^\\s+|\\s+$', '', 'g'), '{mark}', '.'))"


_CLEAN = "trim(regexp_replace(regexp_replace({t}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
_UNESC = "replace(replace(replace(replace(replace(replace(replace({t}, '&lt;', '<'), '&quot;', chr(34)), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&amp;', '&')"
_TITLE_SQL = "[" + ", ".join(f"'{t}'" for t in TITLES) + "]"
_SECTIONS = f"""WITH d AS (SELECT 'W' || doc_id AS work_id, lang, source, string_split(text, chr(10)) AS p FROM documents),
s AS (SELECT work_id, r.i AS n, {_TITLE_SQL}[((r.i - 1) % {len(TITLES)}) + 1] AS title, CASE WHEN (r.i - 1) % 3 = 0 THEN 1 ELSE 2 END AS level, p[r.i + 1] AS t,
  {_TITLE_SQL}[((r.i - 1 - (r.i - 1) % 3) % {len(TITLES)}) + 1] AS top FROM d, range(1, len(p)) r(i)),
k AS (SELECT *, CASE WHEN level = 1 THEN title ELSE top || ' > ' || title END AS path, regexp_matches(title || ' ' || top, '(?i)data|survey|site|area|species|sampling|collection|study|material|method|sample') AS own FROM s),
q AS (SELECT *, regexp_matches(CASE WHEN level = 1 THEN title ELSE top || '|' || title END, '(?i)data|survey|site|area|species|sampling|collection|study|material|method|sample') AS rel FROM k),
picked AS (SELECT *, CAST(row_number() OVER (PARTITION BY work_id ORDER BY n) - 1 AS INT) AS pos FROM q WHERE rel AND trim(regexp_replace(t, '\\s+', ' ', 'g')) <> '')"""
_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"

ORACLE = {
    "heading_classify": f"""WITH d AS ({plain(HEADINGS)}), n AS (SELECT *, {_H} AS h FROM d) SELECT page_id, h AS normalized, CASE {_TYPES} ELSE 'OTHER' END AS section_type,
      heading <> '' AND length(heading) <= 150 AND NOT regexp_matches(trim(heading), '[.!?]$') AND NOT contains(heading, '. ') AS likely, 'Top > ' || heading AS path FROM n""",
    "content_flags": r"""SELECT doc_id, regexp_matches(text, '\$[^\n]*\$') OR regexp_matches(text, '\\\[[^\n]*\\\]') OR contains(lower(text), '<math') OR contains(lower(text), '\begin{equation') AS has_equation,
      regexp_matches(lower(text), '\b(?:table|tab\.?)\s+\d+') OR regexp_matches(lower(text), '\bsee\s+table') AS has_table_mention,
      regexp_matches(lower(text), '\b(?:figure|fig\.?)\s+\d+') OR regexp_matches(lower(text), '\bsee\s+fig') AS has_figure_mention, regexp_matches(text, '(?m)^\[\d+\]') AS has_references_pattern FROM documents""",
    "sentence_split": f"""WITH s AS (SELECT doc_id, {_sentences_sql('¤')} AS x FROM documents) SELECT doc_id, CAST(r.i - 1 AS INT) AS pos, CAST(length(x[r.i]) AS INT) AS n_chars, sha256(x[r.i]) AS sha
      FROM s, range(1, len(x) + 1) r(i)""",
    "sentence_split_at_sign": f"WITH s AS (SELECT doc_id, {_sentences_sql('@')} AS x FROM documents) SELECT doc_id, CAST(len(x) AS INT) AS n, sha256(array_to_string(x, '|')) AS sha FROM s",
    "markup_clean": f"WITH c AS (SELECT page_id, {_CLEAN.format(t=_UNESC.format(t='html'))} AS v FROM pages) SELECT page_id, sha256(v) AS sha, CAST(length(v) AS INT) AS n FROM c",
    "chunk_short_texts": """SELECT conv_id, turn, CAST(0 AS INT) AS chunk_index, CAST(0 AS INT) AS char_start, CAST(length(text) AS INT) AS char_end,
      CAST(len(regexp_extract_all(text, '\\S+')) AS INT) AS token_count, sha256(text) AS sha FROM conversations WHERE regexp_matches(text, '\\S')""",
    "section_select": _SECTIONS + " SELECT work_id, pos, work_id || '_sec_' || n AS section_id, title, path FROM picked",
    "section_prompt": _SECTIONS + """, f AS (SELECT DISTINCT ON (work_id, title) * FROM picked ORDER BY work_id, title, n), b AS (SELECT work_id, string_agg('## ' || title || chr(10) || t || chr(10) || chr(10), '' ORDER BY n) AS body FROM f GROUP BY 1),
      r AS (SELECT d.work_id, CASE WHEN p[1] <> '' THEN '## Abstract' || chr(10) || p[1] || chr(10) || chr(10) ELSE '' END || coalesce(body, '') AS v FROM d LEFT JOIN b USING (work_id))
      SELECT work_id, CAST(length(v) AS INT) AS n_chars, sha256(v) AS sha FROM r""",
    "tei_sections": """WITH d AS (SELECT 'W' || doc_id AS work_id, lang, source, string_split(text, chr(10)) AS p FROM documents)
      SELECT work_id, source AS title, lang AS language, source AS keywords, work_id || '_sec_1' AS section_id, 1 AS level, 'Main' AS path, CAST(NULL AS INT) AS page_start, CAST(NULL AS INT) AS page_end, sha256('intro') AS sha FROM d
      UNION ALL SELECT work_id, source, lang, source, work_id || '_sec_' || (r.i + 1), 2, 'Main > Part ' || r.i, CAST(r.i + 1 AS INT), CAST(r.i + 2 AS INT), sha256(regexp_replace(regexp_replace(p[r.i + 1], '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) FROM d, range(1, len(p)) r(i)""",
    "grounding_crosstab": f"""WITH c AS ({plain(CLAIMS)}), b AS (SELECT 'data_type' AS field, count(*) FILTER (lower(pred_type) = gt_type) AS "match", count(*) FILTER (pred_type IS NULL OR lower(pred_type) <> gt_type) AS gt_only,
      count(*) FILTER (lower(pred_type) <> gt_type) AS pred_only, CAST(0 AS BIGINT) AS overlap_mismatch FROM c) SELECT * FROM b UNION ALL
      SELECT 'species', count(*), CAST(0 AS BIGINT), count(*), CAST(0 AS BIGINT) FROM c""",
    "grounding_benchmark": "SELECT item_id, 'explicit' AS support_type, true AS same_quote FROM benchmark",
    "vector_topk": f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 5) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q}) DESC, vec_id LIMIT 10",
    "vector_topk_filtered": f"""WITH f AS ({plain(FLAGGED)}) SELECT vec_id, section_type, publication_year, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 5) AS score FROM f
      WHERE NOT is_references AND publication_year BETWEEN 2005 AND 2020 AND section_type IN ('METHODS', 'RESULTS') ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q}) DESC, vec_id LIMIT 7""",
    "vector_distances": f"""SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 4) AS cosine, round(list_dot_product(embedding::DOUBLE[], {_Q}), 4) AS dot,
      round(-list_distance(embedding::DOUBLE[], {_Q}), 4) AS euclid FROM embeddings""",
    "vector_stats": """SELECT 'papers_chunks' AS collection_name, count(*) AS points_count, count(embedding) AS vectors_count, CAST(min(len(embedding)) AS INT) AS min_dimensions,
      CAST(max(len(embedding)) AS INT) AS max_dimensions, 'green' AS status FROM embeddings""",
    "vector_point_ids": "SELECT doc_id, CAST(CAST('0x' || substr(md5('W' || doc_id || '_chunk_1'), 1, 16) AS UBIGINT) AS VARCHAR) AS point_id FROM documents",
    "inverted_index_roundtrip": """WITH t AS (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS v FROM documents) SELECT doc_id, CAST(len(list_distinct(string_split(v, ' '))) AS INT) AS n_words, sha256(v) AS sha FROM t""",
    "work_records": """SELECT o_orderkey, 'W' || o_orderkey AS openalex_id, '10.1/' || o_custkey AS doi, 'T ' || o_orderpriority AS title,
      CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS published, 'C' || o_custkey AS first_author, '0-' || o_custkey AS orcid, o_orderkey % 2 = 0 AS is_oa,
      'https://p/' || o_orderkey AS pdf_url, o_orderkey % 5 = 0 AS is_preprint, 'T1' AS topics, 'r1|r2' AS rors FROM orders""",
    "oa_locations": """SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 2 = 0 THEN 'https://x/' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN '/a.pdf' ELSE '/page' END END AS best,
      CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'https://x/' || o_custkey || '/a.pdf|' ELSE '' END || 'https://x/' || o_custkey || '/b.pdf' ELSE '' END AS urls,
      o_orderkey % 11 <> 0 AND o_orderkey % 2 = 0 AS is_oa, false AS repo, CASE WHEN o_orderkey % 11 <> 0 THEN true END AS journal FROM orders""",
    "jsonl_props_extract": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type AS title, '10.1/' || user_id AS doi FROM events",
}
