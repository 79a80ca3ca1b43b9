"""Manifest of data papers: build, integrity, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions import coerce, doi
from concordat.functions.text import blank_to_null, is_blank, normalize_path
from concordat.operators.evaluate import keep_first, keep_last

# Manifest columns in file order.
COLUMNS = ("gt_record_id", "source", "title", "abstract", "source_doi", "source_url", "article_doi", "article_url",
           "pdf_url", "pdf_local_path", "is_oa", "openalex_id", "semantic_scholar_paper_id", "article_publisher")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """The frame itself; reading it fails at the first key that occurs more than once.

    The check is part of the plan, so no job runs here. ``duplicate_keys`` lists
    all of them.
    """
    again = duplicate_keys(df.filter(F.col(key).isNotNull()), key).select(F.col(key).alias("_again"), F.col("n").alias("_n"))
    told = F.raise_error(F.concat(F.lit(f"{key} is not unique: "), F.col("_again").cast("string"), F.lit(" occurs "),
                                  F.col("_n").cast("string"), F.lit(" times")))
    joined = df.join(again, F.col(key) == F.col("_again"), "left")
    checked = F.when(F.col("_again").isNotNull(), told.cast(dict(df.dtypes)[key])).otherwise(F.col(key))
    return joined.withColumn(key, checked).select(*df.columns)


def unknown_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Ids of the list that ``df`` does not have, all of them."""
    return ids.select(F.col(ids.columns[0]).alias(key)).distinct().join(df.select(key), key, "left_anti")


def restrict_to_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of an id list; reading them fails at the first id that does not exist. ``unknown_ids`` lists all."""
    wanted = ids.select(F.col(ids.columns[0]).alias("_wanted")).distinct()
    joined = wanted.join(df.withColumn("_there", F.lit(True)), F.col("_wanted") == F.col(key), "left")
    told = F.raise_error(F.concat(F.lit("no record has the id "), F.col("_wanted").cast("string")))
    checked = F.when(F.col("_there").isNull(), told.cast(dict(df.dtypes)[key])).otherwise(F.col(key))
    return joined.withColumn(key, checked).select(*df.columns)


def with_abstracts(gt: DataFrame, raw: DataFrame | None) -> DataFrame:
    """Left join of the raw texts, only when the frame has no abstract yet."""
    if "abstract" in gt.columns or raw is None:
        return gt
    return gt.join(raw.select(F.col("id").cast("bigint").alias("id"), F.col("full_text").alias("abstract")), "id", "left")


def build(gt: DataFrame, pdf_manifest: DataFrame | None = None, *, raw: DataFrame | None = None,
          subset: DataFrame | None = None, pdf_dir: str = "data/pdfs", order: str | None = None,
          deduplicate_gt: bool = False, allow_missing_pdf: bool = True) -> DataFrame:
    """Manifest rows from the annotation sheet and the download list.

    Duplicate annotation ids are an error unless ``deduplicate_gt`` keeps the
    first (in ``order``). Of several downloads of a record the last in
    ``order`` counts; without an order they are an error too. Errors are raised
    when the manifest is read: nothing runs here.
    """
    sheet = gt.withColumn("id", F.col("id").cast("bigint"))
    sheet = keep_first(sheet, "id", order) if deduplicate_gt else require_unique(sheet, "id")
    sheet = with_abstracts(sheet, raw if raw is None else require_unique(raw, "id"))
    if subset is not None:
        sheet = restrict_to_ids(sheet, subset, "id")
    pdf_cols: list[str] = []
    if pdf_manifest is not None:
        if "record_id" not in pdf_manifest.columns:
            raise ValueError(f"the download list has no record_id among its columns {pdf_manifest.columns}")
        pdfs = pdf_manifest.withColumn("record_id", F.col("record_id").cast("bigint"))
        if order and order not in pdfs.columns:
            raise ValueError(f"the download list has no column {order} to order by")
        pdfs = keep_last(pdfs, "record_id", order) if order else require_unique(pdfs, "record_id")
        pdf_cols = [c for c in ("downloaded_pdf_path", "pdf_url_xlsx", "is_oa") if c in pdfs.columns]
        slim = pdfs.select("record_id", *[F.col(c).alias(f"_pdf_{c}") for c in pdf_cols])
        sheet = sheet.join(slim, sheet["id"] == slim["record_id"], "left")
    have = set(sheet.columns)

    def text(name: str) -> Column:
        return blank_to_null(F.col(name).cast("string")) if name in have else F.lit(None).cast("string")

    def truth(name: str) -> Column:
        if name not in have:
            return F.lit(None).cast("boolean")
        return coerce.flag(F.col(name), dict(sheet.dtypes)[name])

    path = normalize_path(text("_pdf_downloaded_pdf_path"), pdf_dir)
    out = sheet.select(
        F.col("id").alias("gt_record_id"), text("source").alias("source"), text("title").alias("title"),
        text("abstract").alias("abstract"),
        doi.normalize_or_null(doi.from_url(text("source_url"))).alias("source_doi"),
        text("source_url").alias("source_url"),
        doi.normalize_or_null(doi.from_url(text("cited_article_doi"))).alias("article_doi"),
        text("journal_url").alias("article_url"),
        F.coalesce(text("_pdf_pdf_url_xlsx"), text("pdf_url")).alias("pdf_url"), path.alias("pdf_local_path"),
        F.coalesce(truth("_pdf_is_oa"), truth("is_oa")).alias("is_oa"), text("openalex_id").alias("openalex_id"),
        text("semantic_scholar_paper_id").alias("semantic_scholar_paper_id"),
        text("article_publisher").alias("article_publisher"))
    if not allow_missing_pdf and pdf_manifest is not None:
        told = F.raise_error(F.concat(F.lit("no PDF path for record "), F.col("gt_record_id").cast("string"))).cast("string")
        out = out.withColumn("pdf_local_path", F.coalesce("pdf_local_path", told))
    return out


def normalize_manifest(df: DataFrame) -> DataFrame:
    """Both DOI columns in canonical form."""
    return df.withColumns({c: F.when(is_blank(c), F.col(c)).otherwise(doi.normalize_or_null(c))
                           for c in ("source_doi", "article_doi") if c in df.columns})


def canonical_id(df: DataFrame) -> Column:
    return F.coalesce(F.nullif(df["article_doi"], F.lit("")), F.nullif(df["source_doi"], F.lit("")),
                      df["gt_record_id"].cast("string"))


def pdf_coverage(manifest: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Totals of records with a path and with an existing file.

    ``files`` lists existing paths (column ``path``); without it only paths count.
    """
    state = pdf_states(manifest, files)
    return state.agg(F.count(F.lit(1)).alias("total"),
                     F.count_if(F.col("pdf_state") != "no_path").alias("with_pdf_local_path"),
                     F.count_if(F.col("pdf_state") == "on_disk").alias("pdf_on_disk"),
                     F.count_if(F.col("pdf_state") == "missing").alias("missing_from_disk"),
                     F.count_if(F.col("pdf_state") == "no_path").alias("no_pdf_path"))


def pdf_states(manifest: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``pdf_state`` per record: ``no_path``, ``missing`` or ``on_disk``. The id
    lists of the coverage report are filters on it, never collected arrays."""
    has_path = F.coalesce(F.col("pdf_local_path") != "", F.lit(False))
    if files is None:
        return manifest.withColumn("pdf_state", F.when(has_path, "missing").otherwise("no_path"))
    known = files.select(F.col("path").alias("_path")).distinct()
    joined = manifest.join(known, F.col("pdf_local_path") == F.col("_path"), "left")
    return joined.withColumn("pdf_state", F.when(~has_path, "no_path").when(
        F.col("_path").isNull(), "missing").otherwise("on_disk")).drop("_path")


def with_pdf(manifest: DataFrame) -> DataFrame:
    return manifest.filter(F.col("pdf_local_path").isNotNull() & (F.col("pdf_local_path") != ""))


def replace_pdf_path(manifest: DataFrame, record_id: int, path: str) -> DataFrame:
    """Functional update of one record; an unknown id is an error."""
    hit = F.col("gt_record_id") == record_id
    if manifest.filter(hit).isEmpty():
        raise KeyError(f"the manifest has no record {record_id!r}")
    return manifest.withColumn("pdf_local_path", F.when(hit, F.lit(path)).otherwise(F.col("pdf_local_path")))


def coverage_by_source(df: DataFrame) -> DataFrame:
    """Per source: totals, valid records, texts, DOIs and cited articles, with shares as text."""
    n = F.count(F.lit(1))
    share = lambda c: F.format_string("%.1f%%", F.col(c) * 100.0 / F.col("total_records"))
    out = df.groupBy("source").agg(
        n.alias("total_records"), F.count_if(F.col("valid_yn") == "yes").alias("valid_records"),
        F.count("full_text").alias("has_abstract"), F.count_if(doi.mentions_doi("source_url")).alias("has_doi"),
        F.count("cited_article_doi").alias("has_cited_articles"))
    return out.withColumns({"abstract_pct": share("has_abstract"), "doi_pct": share("has_doi")})


def dataset_kpis(df: DataFrame) -> DataFrame:
    """Record counts by repository, open access and PDF address."""
    source = F.lower(F.btrim(F.coalesce("source", F.lit(""))))
    return df.agg(F.count(F.lit(1)).alias("records"), F.count_if(source == "dryad").alias("from_dryad"),
                  F.count_if(source == "zenodo").alias("from_zenodo"),
                  F.count_if(coerce.is_truthy_text("is_oa")).alias("open_access"),
                  F.count_if(~is_blank("pdf_url")).alias("has_pdf_url"))


# ---- Record indexes and enrichment -----------------------------------------


def first_known(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Full outer merge; for every column the primary's value unless it is NULL."""
    a = primary.select(key, *[F.col(c).alias(f"_a_{c}") for c in primary.columns if c != key])
    b = secondary.select(key, *[F.col(c).alias(f"_b_{c}") for c in secondary.columns if c != key])
    names = list(dict.fromkeys([c for c in (*primary.columns, *secondary.columns) if c != key]))
    joined = a.join(b, key, "full_outer")
    pick = [F.coalesce(*[F.col(f"_{s}_{c}") for s, cols in (("a", primary.columns), ("b", secondary.columns))
                         if c in cols]).alias(c) for c in names]
    return joined.select(key, *pick)


def fill_from(df: DataFrame, lookup: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join that only fills NULLs of the named columns."""
    other = lookup.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns])
    joined = df.join(other, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_n_{c}")) if c in df.columns else F.col(f"_n_{c}")
                               for c in columns}).drop(*[f"_n_{c}" for c in columns])


def append_new(mapping: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Mapping plus the candidates whose key it does not hold yet."""
    fresh = candidates.join(mapping.select(key), key, "left_anti")
    return mapping.unionByName(fresh, allowMissingColumns=True)


def stack_keep_last(parts: list[DataFrame], key: str) -> DataFrame:
    """Concatenate tables in order; per key the row of the last table holding it stays."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return keep_last(out, key, "_part").drop("_part")


def ordered_lookup(df: DataFrame, key: str, wanted: DataFrame, position: str, order: str) -> DataFrame:
    """Rows in the order of a key list, first match per key, NULL rows for unknown keys."""
    first = keep_first(df.join(wanted.select(key), key, "left_semi"), key, order)
    return wanted.join(first, key, "left").orderBy(position)


def pdf_source(df: DataFrame) -> DataFrame:
    """First available address along the open fallback chain, and which step gave it.

    Columns ``existing_path``, ``work_pdf_url``, ``oa_pdf_urls`` (array) are
    staged availability; the tried address is not tried again.
    """
    alternatives = F.filter(F.coalesce("oa_pdf_urls", F.array().cast("array<string>")),
                            lambda u: ~u.eqNullSafe(F.col("work_pdf_url")))
    steps = [("existing", F.col("existing_path")), ("work", F.col("work_pdf_url")),
             ("open_access", F.get(alternatives, F.lit(0))), ("publisher_guess", doi.publisher_pdf_url("doi"))]
    strategy = F.coalesce(*[F.when(c.isNotNull() & (c != ""), name) for name, c in steps])
    return df.withColumns({"pdf_strategy": strategy,
                           "pdf_source": F.coalesce(*[F.nullif(c, F.lit("")) for _, c in steps])})
