"""Best matches between two name lists as a similarity join: each distinct pair of names is scored once.

``functions.similarity`` matches the lists of a record inside its row. That needs no
shuffle, but scores a pair again in every record it occurs in, and leaves a record with
very long lists to one task. Here names become rows:

* lists meet in blocks of (record, part of the truth list), so a long list is spread
  over tasks; a record's short lists are one block;
* a pair survives only if bounds that the JVM compares leave the threshold within
  reach: lengths, and the letters (as bits) that one name has and the other
  lacks - each costs at least one deletion. Containment of names counts as well;
* survivors of all records are made distinct, and only those reach the scoring function, which
  runs the bit-parallel subsequence;
* the order of the truth list decides ties, as in the row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.functions.similarity import PART_CONTAINED, _pair_score
from concordat.functions.text import let

#: Truth names of a record that a block holds.
BLOCK = 512
SCORE = T.StructType([T.StructField("hit", T.BooleanType()), T.StructField("score", T.DoubleType())])


@F.arrow_udf(SCORE)
def _scored(truth: pa.Array, pred: pa.Array, threshold: pa.Array) -> pa.Array:
    found = [_pair_score(t, p, h) for t, p, h in zip(truth.to_pylist(), pred.to_pylist(), threshold.to_pylist())]
    return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.bool_()), pa.array([f[1] for f in found], pa.float64())],
                                      names=["hit", "score"])


#: Declared non-deterministic only as a barrier: nothing may be pushed below it.
_scored_once = _scored.asNondeterministic()


def letter_bits(text: Column) -> Column:
    """The letters of a text as bits of a long; letters may share a bit, which only loosens a bound."""
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)))))


def _measured(forms: Column) -> Column:
    """Each form of a name with its length and letters."""
    return F.transform(forms, lambda x: F.struct(x.alias("text"), F.length(x).alias("size"), letter_bits(x).alias("bits")))


def _within_reach(a: Column, b: Column, threshold: float) -> Column:
    """Whether two measured forms may reach the threshold."""
    total = a["size"] + b["size"]
    lacking = F.bit_count(a["bits"].bitwiseAND(F.bitwise_not(b["bits"]))) + F.bit_count(b["bits"].bitwiseAND(F.bitwise_not(a["bits"])))
    gap = F.greatest(F.abs(a["size"] - b["size"]), lacking)
    return gap <= (1 - threshold / 100) * total + 1e-9


def candidates(rows: DataFrame, key: str, truths: str, preds: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """(key, at, place, truth, pred): pairs of names of one record that the bounds leave, ``at`` in its predictions,
    ``place`` in its truths. Predictions that need no match (without parts, and equal to a truth) are left out."""
    # Lists are exploded as expressions: Spark filters empty columns early, and would make all forms once more for that.
    exact = F.transform(truths, lambda t: t[0])
    named = F.transform(preds, lambda p, i: F.struct(i.alias("at"), p.alias("pred"), _measured(p).alias("p")))
    open_preds = let(exact, lambda known: F.filter(named, lambda p: (
        F.size(p["pred"]) > 1) | F.lit(threshold > 100) | ~F.array_contains(known, p["pred"][0])))
    last = F.floor((F.size(truths) - 1) / block).cast("int")
    left = rows.select(key, F.posexplode(F.transform(truths, lambda t: F.struct(t.alias("truth"), _measured(t).alias("t")))).alias("place", "x"))
    left = left.select(key, "place", "x.truth", F.floor(F.col("place") / block).cast("int").alias("block"), "x.t")
    right = rows.select(key, F.explode(open_preds).alias("x"), last.alias("last")).select(key, "x.at", "x.pred", "x.p", "last")
    right = right.select(key, "at", "pred", "p", F.explode(F.sequence(F.lit(0), "last")).alias("block"))
    met = left.join(right, [key, "block"])
    if threshold <= PART_CONTAINED:
        t, p = F.col("t"), F.col("p")
        parts = (F.size(t) > 1) | (F.size(p) > 1)
        inside = F.contains(p[0]["text"], t[0]["text"]) | F.exists(F.slice(t, 2, F.size(t)), lambda x: F.contains(p[0]["text"], x["text"]))
        by_parts = F.exists(F.slice(t, 2, F.size(t)), lambda x: F.exists(F.slice(p, 2, F.size(p)), lambda y: _within_reach(x, y, threshold)))
        met = met.where(_within_reach(t[0], p[0], threshold) | (parts & (inside | by_parts)))
    return met.select(key, "at", "place", "truth", "pred")


def scored(pairs: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` with ``hit`` and ``score``; the scoring function sees each distinct pair of names once."""
    distinct = pairs.select("truth", "pred").distinct()
    scores = distinct.withColumn("s", _scored_once("truth", "pred", F.lit(float(threshold))))
    return pairs.join(scores, ["truth", "pred"]).select(*pairs.columns, "s.hit", "s.score")


def best_matches(rows: DataFrame, key: str, truths: str, preds: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """(key, at, match): the truth that each prediction of each record matches best; only those that match one.

    A later truth must score higher than all before it, matching or not. An empty truth renames nothing.
    """
    pairs = scored(candidates(rows, key, truths, preds, threshold, block), threshold)
    seen = pairs.groupBy(key, "at").agg(F.array_sort(F.collect_list(F.struct(
        "place", F.col("truth")[0].alias("name"), "hit", "score"))).alias("seen"))
    state = F.struct(F.lit(0.0).alias("top"), F.lit(None).cast("string").alias("match"))
    best = F.aggregate("seen", state, lambda s, x: F.when((s["top"] < 100) & (x["score"] > s["top"]), F.struct(
        x["score"].alias("top"), F.when(x["hit"], x["name"]).otherwise(s["match"]).alias("match"))).otherwise(s), lambda s: s["match"])
    return seen.select(key, "at", best.alias("match")).where("match <> ''")


def renamed(rows: DataFrame, key: str, truths: str, preds: str, threshold: float, out: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``out``: the predictions of each record as a set, each renamed to the truth it matches best.

    ``truths`` and ``preds`` are lists of name forms (``similarity.list_forms``); ``key`` tells records apart.
    """
    matches = best_matches(rows.select(key, truths, preds), key, truths, preds, threshold, block)
    by_record = matches.groupBy(F.col(key).alias("_record")).agg(F.map_from_entries(F.collect_list(F.struct("at", "match"))).alias("_match"))
    joined = rows.join(by_record, F.col(key) == F.col("_record"), "left")
    named = F.transform(preds, lambda p, i: F.coalesce(F.try_element_at("_match", i), p[0]))
    return joined.withColumn(out, F.array_distinct(named)).drop("_record", "_match")
