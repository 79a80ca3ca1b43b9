"""Lookups against staged copies of external catalogues.

The studied tool calls web services one record at a time. Here each service
is a staged table (Parquet or JSON landed by an ingest job) and a lookup is a
join, so a million records cost one pass instead of a million calls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.functions import doi
from concordat.session import broadcast_if_small


def tagged(df: DataFrame, source: str) -> DataFrame:
    """Repository records with the repository's name."""
    return df.withColumn("source", F.lit(source))


def union_pages(pages: list[DataFrame], limit: int | None = None) -> DataFrame:
    """Result pages as one frame, optionally cut at ``limit`` rows (a search's own limit)."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pages)
    return out.limit(limit) if limit is not None else out


def search_repository(records: DataFrame, query: str, source: str) -> DataFrame:
    """Records whose title or description holds every query word."""
    hit = F.lit(True)
    for word in query.lower().split():
        hit = hit & (F.lower("title").contains(word) | F.lower("description").contains(word))
    return tagged(records.filter(hit), source)


def by_dois(records: DataFrame, wanted: list[str], column: str = "doi") -> DataFrame:
    """Records for a list of DOIs in any spelling."""
    bare = [doi.normalize(F.lit(w)) for w in wanted]
    return records.filter(doi.normalize(column).isin(*bare) if bare else F.lit(False))


def search_works(works: DataFrame, *, ror_id: str | None = None, year: int | None = None,
                 years: tuple[int, int] | None = None, is_oa: bool | None = None, topics: list[str] | None = None,
                 work_type: str | None = None, keyword: str | None = None, limit: int | None = None) -> DataFrame:
    """Conjunctive work search; topics are alternatives. Simple predicates reach the scan."""
    keep = F.lit(True)
    if year is not None:
        keep = keep & (F.col("publication_year") == year)
    if years is not None:
        keep = keep & F.col("publication_year").between(*years)
    if is_oa is not None:
        keep = keep & (F.col("is_oa") == is_oa)
    if work_type is not None:
        keep = keep & (F.col("work_type") == work_type)
    if ror_id is not None:
        keep = keep & F.array_contains("institutions", ror_id)
    if topics:
        keep = keep & F.arrays_overlap("topics", F.array(*[F.lit(t) for t in topics]))
    if keyword:
        text = F.lower(F.concat_ws(" ", "title", "abstract"))
        keep = keep & text.contains(keyword.lower())
    found = works.filter(keep)
    return found.limit(limit) if limit is not None else found


def lookup_by_doi(requests: DataFrame, catalogue: DataFrame, *, request_doi: str = "doi",
                  catalogue_doi: str = "doi", prefix: str = "found_") -> DataFrame:
    """Left join on the normalised DOI; unknown DOIs keep NULL columns.

    Of catalogue rows with one DOI the first in order of their columns counts,
    so a request stays one row. Requests without a DOI join nothing and are
    spread by a hash of their own columns instead of meeting in one task (a
    repeated task deals them alike).
    """
    other = catalogue.select(doi.normalize_or_null(catalogue_doi).alias("_key"), F.struct(*catalogue.columns).alias("_row"))
    other = other.filter(F.col("_key").isNotNull()).groupBy("_key").agg(F.min("_row").alias("_row"))
    keyed = requests.withColumn("_doi", doi.normalize_or_null(request_doi))
    keyed = keyed.withColumn("_key", F.coalesce("_doi", F.concat(F.lit("\x00"), F.xxhash64(*requests.columns).cast("string"))))
    joined = keyed.join(broadcast_if_small(other), "_key", "left")
    return joined.select(*requests.columns, *[F.col("_row")[c].alias(f"{prefix}{c}") for c in catalogue.columns])


def title_search(requests: DataFrame, papers: DataFrame, *, key: str, title: str = "title") -> DataFrame:
    """First hit per requested title: equal after lower-casing and blank collapsing, newest first."""
    norm = lambda c: F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    other = papers.select(norm(title).alias("_key"), *[F.col(c).alias(f"hit_{c}") for c in papers.columns])
    newest = other.groupBy("_key").agg(F.max_by(F.struct(*[c for c in other.columns if c != "_key"]), F.struct(
        F.coalesce("hit_year", F.lit(0)), "hit_paper_id")).alias("hit"))
    return requests.withColumn("_key", norm(title)).join(newest, "_key", "left").select(
        *requests.columns, F.col("hit.hit_paper_id").alias("hit_paper_id"), F.col("hit.hit_year").alias("hit_year"))


def citing(edges: DataFrame, papers: DataFrame, cited: str) -> DataFrame:
    """Papers that cite ``cited``. ``edges`` holds (citing, cited) pairs."""
    chosen = edges.filter(F.col("cited") == cited).select(F.col("citing").alias("paper_id"))
    return papers.join(chosen, "paper_id", "left_semi")


def references(edges: DataFrame, papers: DataFrame, source: str) -> DataFrame:
    chosen = edges.filter(F.col("citing") == source).select(F.col("cited").alias("paper_id"))
    return papers.join(chosen, "paper_id", "left_semi")


def open_access_pdf(papers: DataFrame) -> DataFrame:
    return papers.withColumn("oa_pdf_url", F.nullif("open_access_pdf.url", F.lit("")))


def observation_summary(observations: DataFrame, taxa: DataFrame, *, years: tuple[int, int] = (1950, 2024)) -> DataFrame:
    """Distinct taxa and observations per taxon group within a year range."""
    seen = observations.filter(F.col("year").between(*years))
    joined = seen.join(broadcast_if_small(taxa.select("id_taxa_obs", "group_name")), "id_taxa_obs")
    return joined.groupBy("group_name").agg(F.countDistinct("id_taxa_obs").alias("taxa_count"),
                                            F.count(F.lit(1)).alias("obs_count"))
