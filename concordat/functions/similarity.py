"""Fuzzy string and taxon-name similarity.

The score is normalised Indel similarity: ``200 * LCS / (len a + len b)``.
Spark has no built-in for it (``levenshtein`` also counts substitutions).
Two routes give the same number:

* ``indel_ratio_sql`` - higher-order functions only, stays in the JVM;
* ``indel_ratio`` - Arrow UDF, the LCS row kept as the bits of one integer.
  bench.py's ``eval_fuzzy_list`` shows why it is the default: lambda
  expressions are interpreted per cell of the dynamic-programming table.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.functions.arrays import empty_if_null
from concordat.functions.text import NON_WS, WS, as_col, let, strip, words

CONTAINED = 95.0      # truth inside the prediction
PART_CONTAINED = 90.0  # a part of the truth name inside the prediction


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, one big-integer step per character of ``b``."""
    positions: dict[str, int] = {}
    for i, ch in enumerate(a):
        positions[ch] = positions.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & positions.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@lru_cache(maxsize=1 << 16)
def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 100.0


def indel_ratio_sql(a: Column | str, b: Column | str) -> Column:
    a, b = as_col(a), as_col(b)
    total = F.length(a) + F.length(b)
    b_chars = F.split(b, "")

    def next_row(prev: Column, ch: Column) -> Column:
        def cell(row: Column, j: Column) -> Column:
            same = F.get(b_chars, j - 1) == ch
            best = F.greatest(F.get(prev, j), F.element_at(row, -1))
            return F.array_append(row, F.when(same, F.get(prev, j - 1) + 1).otherwise(best))
        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    start = F.array_repeat(F.lit(0), F.length(b) + 1)
    lcs = F.aggregate(F.split(a, ""), start, next_row, lambda row: F.element_at(row, -1))
    return (F.when(total == 0, 100.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0)
            .when(total > 0, F.lit(200.0) * lcs / total))


@F.arrow_udf(T.DoubleType())
def _ratio_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    pairs = zip(a.to_pylist(), b.to_pylist())
    return pa.array([None if x is None or y is None else ratio(x, y) for x, y in pairs], pa.float64())


_ratio_barrier = _ratio_udf.asNondeterministic()  # see _rename_barrier


def indel_ratio(a: Column | str, b: Column | str) -> Column:
    return _ratio_barrier(as_col(a), as_col(b))


def _pair_score(truth: list[str], pred: list[str], threshold: float) -> tuple[bool, float]:
    """Score two names given as ``[lowered full text, part, part, ...]``.

    Checks run in a fixed order and the first that reaches the threshold
    decides: full text, then name parts pairwise, then containment.
    A pair whose length bound cannot reach the threshold is not aligned.
    """
    full_t, full_p = truth[0], pred[0]
    if full_t == full_p:
        return True, 100.0
    best = 0.0
    seen = set()
    for x, y in [(full_t, full_p), *((x, y) for x in truth[1:] for y in pred[1:])]:
        if (x, y) in seen:
            continue
        seen.add((x, y))
        total = len(x) + len(y)
        reachable = 200.0 * min(len(x), len(y)) / total if total else 100.0
        if reachable < threshold <= PART_CONTAINED or reachable <= best:
            continue
        score = ratio(x, y)
        if score >= threshold:
            return True, score
        best = max(best, score)
    if len(truth) > 1 or len(pred) > 1:  # taxon names; plain fuzzy has no parts
        if full_t in full_p:
            return True, CONTAINED
        if any(part in full_p for part in truth[1:]):
            return True, PART_CONTAINED
    return best >= threshold, best


def _canonical_predictions(truths: list[list[str]], preds: list[list[str]], threshold: float) -> list[str]:
    """Each prediction renamed to the truth it matches best; ties keep the earlier truth."""
    exact = {t[0] for t in truths}
    out = []
    for pred in preds:
        name = pred[0]
        # Without name parts only equal text scores 100, so equality settles it.
        if len(pred) > 1 or name not in exact or threshold > 100:
            top, match = 0.0, None
            for truth in truths:
                hit, score = _pair_score(truth, pred, threshold)
                if score > top:
                    top = score
                    match = truth[0] if hit else match
                    if top >= 100.0:
                        break
            name = match or name
        out.append(name)
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def _rename_to_truth(truths: pa.Array, preds: pa.Array, threshold: pa.Array) -> pa.Array:
    rows = zip(truths.to_pylist(), preds.to_pylist(), threshold.to_pylist())
    return pa.array([_canonical_predictions(t, p, th) for t, p, th in rows], pa.list_(pa.string()))


# Declared non-deterministic only as a barrier: a filter on a match outcome must
# stay above the UDF, not be pushed into the join that feeds it.
_rename_barrier = _rename_to_truth.asNondeterministic()


def looks_scientific(value: Column | str) -> Column:
    """Capitalised first word followed by a lower-case second word."""
    return F.coalesce(strip(value).rlike(rf"^\p{{Lu}}{NON_WS}*{WS}+\p{{Ll}}"), F.lit(False))


PAREN_NAME = rf"^([^()]+?){WS}*\(([^()]+)\){WS}*\z"


def split_paren_name(value: Column) -> Column:
    """``before (inside)`` as a struct of stripped texts; NULL fields without parentheses."""
    has = value.rlike(PAREN_NAME)
    return F.struct(F.when(has, strip(F.regexp_extract(value, PAREN_NAME, 1))).alias("before"),
                    F.when(has, strip(F.regexp_extract(value, PAREN_NAME, 2))).alias("inside"))


def name_parts(value: Column | str) -> Column:
    """Lowered ``scientific`` / ``vernacular`` / ``full`` parts of a taxon name."""
    def build(c: Column) -> Column:
        name, before, inside = c["name"], c["paren"]["before"], c["paren"]["inside"]
        has_paren = before.isNotNull()
        binomial = name.rlike(rf"^\p{{Lu}}{NON_WS}+{WS}+{NON_WS}")  # two words, the first of two letters or more
        first = F.when(has_paren, F.when(looks_scientific(before), 1).when(looks_scientific(inside), 2))
        sci = F.when(first == 1, before).when(first == 2, inside).when(~has_paren & binomial, name)
        ver = F.when(first == 1, inside).when(first == 2, before).when(~has_paren & ~binomial, name)
        full = F.when(~has_paren | first.isNull(), name)
        return F.when(c["given"], F.struct(F.lower(sci).alias("scientific"), F.lower(ver).alias("vernacular"),
                                           F.lower(full).alias("full")))

    raw = as_col(value)
    return let(let(strip(raw), lambda s: F.struct(s.alias("name"), split_paren_name(s).alias("paren"), (
        raw != "").alias("given"))), build)


def _name_forms(item: Column, taxon_aware: bool) -> Column:
    lowered = strip(F.lower(item))
    if not taxon_aware:
        return F.array(lowered)
    return let(name_parts(item), lambda p: F.array_compact(
        F.array(lowered, p["scientific"], p["vernacular"], p["full"])))


def list_forms(arr: Column, *, taxon_aware: bool) -> Column:
    """Names of a list prepared for matching; a NULL list is empty."""
    items = F.transform(empty_if_null(arr), lambda x: F.coalesce(x.cast("string"), F.lit("None")))
    return F.transform(items, lambda x: _name_forms(x, taxon_aware))


def lowered_set(forms: Column) -> Column:
    return F.array_distinct(F.transform(forms, lambda x: x[0]))


def renamed_set(truth_forms: Column, pred_forms: Column, threshold: float) -> Column:
    """Predictions as a set, each renamed to the truth it matches best.

    Lists stay in their row: no pairs are emitted and nothing is shuffled.
    """
    return F.array_distinct(_rename_barrier(truth_forms, pred_forms, F.lit(float(threshold))))


def match_lists(truth: Column, pred: Column, threshold: float, *, taxon_aware: bool) -> Column:
    """Two name lists as comparable sets ``struct(truth, pred)``."""
    truths, preds = list_forms(truth, taxon_aware=taxon_aware), list_forms(pred, taxon_aware=taxon_aware)
    return F.struct(lowered_set(truths).alias("truth"), renamed_set(truths, preds, threshold).alias("pred"))
