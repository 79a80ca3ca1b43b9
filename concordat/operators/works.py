"""Bibliographic work records: nested JSON to flat columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.text import let

# The part of a work record that is read.
WORK_SCHEMA = (
    "id string, doi string, title string, publication_date string, publication_year int, type string, "
    "abstract_inverted_index map<string,array<int>>, "
    "authorships array<struct<author:struct<display_name:string,orcid:string>,institutions:array<struct<ror:string>>>>, "
    "open_access struct<is_oa:boolean,oa_status:string>, "
    "best_oa_location struct<pdf_url:string,landing_page_url:string>, topics array<struct<id:string>>")
OA_ARTICLE_SCHEMA = (
    "doi string, is_oa boolean, oa_status string, has_repository_copy boolean, journal_is_oa boolean, "
    "journal_is_in_doaj boolean, best_oa_location struct<url_for_pdf:string,url:string>, "
    "oa_locations array<struct<url_for_pdf:string,url:string>>")
ORCID_PREFIX = "https://orcid.org/"


def _null_if_empty(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, arr)


def abstract_text(inverted: Column) -> Column:
    """Words of an inverted index (word -> positions) put back in order.

    Works inside the row: positions are sorted as an array, nothing is shuffled.
    """
    placed = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(
        e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    ordered = F.array_sort(placed)
    return F.when(F.size(inverted) > 0, F.array_join(F.transform(ordered, lambda x: x["w"]), " "))


def invert_text(text: Column | str) -> Column:
    """The inverse: text to a map of word -> 0-based positions (per row).

    Sorted (word, position) pairs are cut where the word changes.
    """
    tokens = F.split(F.col(text) if isinstance(text, str) else text, " ")
    ordered = F.array_sort(F.transform(tokens, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))

    def cut(pairs: Column) -> Column:
        begins = F.filter(F.transform(pairs, lambda x, i: F.when(
            (i == 0) | ~x["w"].eqNullSafe(F.get(pairs, i - 1)["w"]), i)), lambda i: i.isNotNull())

        def group(starts: Column) -> Column:
            return F.map_from_entries(F.transform(starts, lambda a, j: F.struct(F.get(pairs, a)["w"].alias("w"), F.transform(
                F.slice(pairs, a + 1, F.coalesce(F.get(starts, j + 1), F.size(pairs)) - a), lambda x: x["p"]).alias("ps"))))

        return let(begins, group)

    return let(ordered, cut)


def authors(authorships: Column) -> Column:
    def one(a: Column) -> Column:
        orcid = F.replace(a["author"]["orcid"], F.lit(ORCID_PREFIX), F.lit(""))
        rors = F.filter(F.transform(a["institutions"], lambda i: i["ror"]), lambda r: r.isNotNull() & (r != ""))
        return F.struct(a["author"]["display_name"].alias("name"), orcid.alias("orcid"),
                        _null_if_empty(rors).alias("institutions"))

    return _null_if_empty(F.transform(authorships, one))


def flatten_works(works: DataFrame, column: str = "work") -> DataFrame:
    """Flat work columns from the parsed struct ``column`` (see ``WORK_SCHEMA``)."""
    w = lambda path: F.col(f"{column}.{path}")
    people = authors(w("authorships"))
    rors = F.array_sort(F.array_distinct(F.flatten(F.filter(
        F.transform(people, lambda a: a["institutions"]), lambda x: x.isNotNull()))))
    topics = F.filter(F.transform(w("topics"), lambda t: t["id"]), lambda t: t.isNotNull() & (t != ""))
    others = [c for c in works.columns if c != column]
    return works.select(
        *others, F.coalesce(w("id"), F.lit("")).alias("openalex_id"), w("doi").alias("doi"),
        F.coalesce(w("title"), F.lit("")).alias("title"), abstract_text(w("abstract_inverted_index")).alias("abstract"),
        F.try_to_date(w("publication_date"), "yyyy-MM-dd").alias("publication_date"),
        w("publication_year").alias("publication_year"), people.alias("authors"),
        F.coalesce(w("open_access.is_oa"), F.lit(False)).alias("is_oa"), w("open_access.oa_status").alias("oa_status"),
        w("best_oa_location.pdf_url").alias("pdf_url"), w("best_oa_location.landing_page_url").alias("landing_page_url"),
        w("type").alias("work_type"), (F.lower(F.coalesce(w("type"), F.lit(""))) == "preprint").alias("is_preprint"),
        _null_if_empty(topics).alias("topics"), _null_if_empty(rors).alias("institutions"))


def parse_works(lines: DataFrame, text: str = "value") -> DataFrame:
    others = [c for c in lines.columns if c != text]
    return flatten_works(lines.select(*others, F.from_json(text, WORK_SCHEMA).alias("work")))


# ---- Open-access article records -------------------------------------------


def best_pdf_url(article: Column) -> Column:
    """Direct PDF of the best open location, else its page; NULL unless open access."""
    best = article["best_oa_location"]
    return F.when(F.coalesce(article["is_oa"], F.lit(False)),
                  F.coalesce(F.nullif(best["url_for_pdf"], F.lit("")), best["url"]))


def all_pdf_urls(article: Column) -> Column:
    """Distinct PDF addresses in listing order; pages count only when they end in .pdf."""
    urls = F.flatten(F.transform(article["oa_locations"], lambda loc: F.array(
        loc["url_for_pdf"], F.when(loc["url"].endswith(".pdf"), loc["url"]))))
    kept = F.array_distinct(F.filter(urls, lambda u: u.isNotNull() & (u != "")))
    return F.when(F.coalesce(article["is_oa"], F.lit(False)), kept).otherwise(F.array().cast("array<string>"))


def oa_status(article: Column) -> Column:
    """Status struct with defaults; the journal fields stay NULL for an unknown article."""
    known = article.isNotNull()
    off = lambda name: F.coalesce(article[name], F.lit(False))
    return F.struct(off("is_oa").alias("is_oa"), article["oa_status"].alias("oa_status"),
                    off("has_repository_copy").alias("has_repository_copy"),
                    F.when(known, off("journal_is_oa")).alias("journal_is_oa"),
                    F.when(known, off("journal_is_in_doaj")).alias("journal_is_in_doaj"))
