"""DOI handling as column expressions."""

from __future__ import annotations

from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.functions.text import as_col, strip

PREFIX = r"^(?i)(?:https?://doi\.org/|doi:)"

# Registrant prefix -> where that publisher serves PDF files.
PUBLISHER_PDF = (
    ("10.1111/", "https://onlinelibrary.wiley.com/doi/pdfdirect/{doi}"),
    ("10.1002/", "https://onlinelibrary.wiley.com/doi/pdfdirect/{doi}"),
    ("10.1890/", "https://onlinelibrary.wiley.com/doi/pdfdirect/{doi}"),
    ("10.1007/", "https://link.springer.com/content/pdf/{doi}.pdf"),
    ("10.1038/", "https://www.nature.com/articles/{suffix}.pdf"),
    ("10.1017/", "https://www.cambridge.org/core/services/aop-cambridge-core/content/view/{doi}"),
    ("10.3897/", "https://doi.org/{doi}"),
)


def strip_prefix(value: Column | str) -> Column:
    """Bare DOI; NULL is treated as empty text."""
    return strip(F.regexp_replace(strip(F.coalesce(as_col(value), F.lit(""))), PREFIX, ""))


def normalize(value: Column | str) -> Column:
    return F.lower(strip_prefix(value))


def normalize_or_null(value: Column | str) -> Column:
    """Manifest rule: non-blank text is normalised; an empty result is NULL."""
    return F.nullif(normalize(value), F.lit(""))


def same(a: Column | str, b: Column | str) -> Column:
    """Equality where NULL never equals anything, itself included."""
    a, b = as_col(a), as_col(b)
    return a.isNotNull() & b.isNotNull() & (normalize(a) == normalize(b))


def filename_stem(value: Column | str) -> Column:
    return F.translate(strip_prefix(value), "/", "_")


def sanitize(value: Column | str) -> Column:
    """File-name safe form, also for malformed DOIs."""
    return F.translate(strip_prefix(value), "/\\: ", "____")


def from_url(value: Column | str) -> Column:
    """The bare DOI a URL or DOI text holds, else NULL; case is kept."""
    bare = strip_prefix(value)
    return F.when(bare.rlike(r"^10\.[0-9]{4,}"), bare)


def mentions_doi(value: Column | str) -> Column:
    return F.coalesce(as_col(value).rlike(r"(?i)doi\.org/"), F.lit(False))


@F.arrow_udf(T.StringType())
def _percent_encode(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else quote(v, safe="10./:-_") for v in values.to_pylist()], pa.string())


def candidate_variants(value: Column | str) -> Column:
    """Every spelling under which a DOI may be stored, in lookup order.

    Percent-encoding has a custom safe set no built-in offers; it runs as an
    Arrow UDF over the normalised text.
    """
    bare = normalize(value)
    # url_decode also turns '+' into a blank, so a literal plus is protected first.
    decoded = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    spellings = F.array(bare, F.concat(F.lit("https://doi.org/"), bare), F.concat(F.lit("doi:"), bare),
                        decoded, _percent_encode(bare))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.array_distinct(spellings))


def publisher_pdf_url(value: Column | str) -> Column:
    """Likely direct PDF address for known registrants."""
    doi = strip(value)
    suffix = F.regexp_replace(doi, "^[^/]*/", "")
    out = F.lit(None).cast("string")
    for prefix, template in reversed(PUBLISHER_PDF):
        head, _, rest = template.partition("{")
        name, _, tail = rest.partition("}")
        part = doi if name == "doi" else suffix
        out = F.when(doi.startswith(prefix), F.concat(F.lit(head), part, F.lit(tail))).otherwise(out)
    return out
