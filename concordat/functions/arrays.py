"""Array helpers: set counters, order-preserving distinct, value normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat.functions.text import as_col, casefold, let, normalize_string


def empty_if_null(arr: Column, like: str = "array<string>") -> Column:
    return F.coalesce(arr, F.array().cast(like))


def null_if_empty(arr: Column) -> Column:
    return let(arr, lambda a: F.when(F.size(a) > 0, a))


def set_counts(truth: Column, pred: Column) -> Column:
    """tp / fp / fn of two non-NULL arrays taken as sets."""
    tp = F.size(F.array_intersect(truth, pred))
    fp = F.size(F.array_except(pred, truth))
    fn = F.size(F.array_except(truth, pred))
    return F.struct(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))


def distinct_casefold(arr: Column | str) -> Column:
    """Distinct ignoring case; the first spelling of each key survives."""
    def keep_first(s: Column) -> Column:
        keys, items = s["k"], s["a"]
        return F.transform(F.array_distinct(keys),
                           lambda k: F.get(items, (F.array_position(keys, k) - 1).cast("int")))

    return let(let(as_col(arr), lambda a: F.struct(F.transform(a, casefold).alias("k"), a.alias("a"))), keep_first)


def normalize_items(arr: Column, element_type: str, *, strip_ends: bool = True, collapse: bool = True,
                    fold: bool = True, as_set: bool = True) -> Column:
    """Comparison form of a list: NULL items dropped, strings normalised."""
    items = F.filter(arr, lambda x: x.isNotNull())
    if element_type == "string":
        items = F.transform(items, lambda x: normalize_string(
            x, strip_ends=strip_ends, collapse=collapse, fold=fold))
    return F.array_distinct(items) if as_set else items
