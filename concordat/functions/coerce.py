"""Spreadsheet-cell coercion: placeholders, numbers, years, booleans, lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat.functions.text import as_col, let, strip

# Cell texts that mean "no value".
NULL_PLACEHOLDERS = ("not given", "not_given", "na", "n/a", "nan", "none", "")

# Accepted spellings of a flag.
TRUE_TEXT = ("yes", "true", "1")
FALSE_TEXT = ("no", "false", "0")

NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def clean_cell(value: Column | str) -> Column:
    """Stripped text; placeholders become NULL, decimal commas become points."""
    def clean(v: Column) -> Column:
        numeric_with_comma = v.contains(",") & v.rlike(r"^[\p{Nd},.\-]+$") & v.rlike(r"\p{Nd}")
        return (F.when(F.lower(v).isin(*NULL_PLACEHOLDERS), F.lit(None))
                .when(numeric_with_comma, F.translate(v, ",", ".")).otherwise(v))

    return let(strip(as_col(value)), clean)


def number(value: Column | str) -> Column:
    """Text to double; text that is not a plain number is NULL."""
    return let(strip(as_col(value)), lambda v: F.when(v.rlike(NUMBER), v.try_cast("double")))


def spatial_range(value: Column | str) -> Column:
    return number(F.replace(F.translate(as_col(value), ",", "."), F.lit(" "), F.lit("")))


def year(value: Column | str) -> Column:
    """Whole years; fractions are cut off."""
    return number(value).try_cast("int")


def temporal_text(value: Column, data_type: str = "string") -> Column:
    if data_type in ("double", "float", "int", "bigint"):
        return F.when(~F.isnan(value.cast("double")), value.cast("bigint").cast("string"))
    return strip(value)


def flag(value: Column, data_type: str = "string") -> Column:
    """Booleans from flags, numbers (by truth) or text; other text is NULL."""
    if data_type == "boolean":
        return value
    if data_type in ("double", "float"):
        return F.when(~F.isnan(value), value != 0)
    if data_type in ("int", "bigint", "smallint", "tinyint"):
        return value != 0
    return let(F.lower(strip(value)), lambda v: F.when(v.isin(*TRUE_TEXT), True).when(v.isin(*FALSE_TEXT), False))


def is_true_label(value: Column, data_type: str = "string") -> Column:
    """Strict truth: boolean true or the text true/1/yes; a numeric 1 is not true."""
    if data_type == "boolean":
        return F.coalesce(value, F.lit(False))
    if data_type == "string":
        return F.coalesce(F.lower(value).isin("true", "1", "yes"), F.lit(False))
    return F.lit(False)


def is_truthy_text(value: Column | str) -> Column:
    """Open-access style flags as they come out of CSV files."""
    return F.coalesce(F.lower(strip(as_col(value).cast("string"))).isin("1", "1.0", "true", "yes"), F.lit(False))


def _list_literal(text: Column) -> Column:
    """A bracketed list literal (single or double quotes) as an array, NULL if malformed."""
    options = {"allowSingleQuotes": "true", "mode": "PERMISSIVE"}
    tokens = F.replace(text, F.lit("None"), F.lit("null"))
    return F.from_json(tokens, "array<string>", options)


def atomic_list(value: Column | str) -> Column:
    """Any cell as a list of non-blank texts: list literal, or the text itself."""
    v = strip(as_col(value))
    literal = F.when(v.startswith("[") & v.endswith("]"), _list_literal(v))
    items = F.coalesce(literal, F.array(v))
    kept = F.filter(F.transform(items, strip), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def list_cell(value: Column | str) -> Column:
    """Spreadsheet cell of a list column: list literal, else one-item list; blank is NULL."""
    v = strip(as_col(value))
    literal = F.when(v.startswith("["), _list_literal(v))
    return F.when(v != "", F.coalesce(literal, F.array(v)))


def csv_cell(value: Column, data_type: str) -> Column:
    """Cell text of the extraction CSV: NULL is empty, nested values are JSON."""
    if data_type.startswith(("array", "map", "struct")):
        return F.coalesce(F.to_json(value), F.lit(""))
    return F.coalesce(value.cast("string"), F.lit(""))
