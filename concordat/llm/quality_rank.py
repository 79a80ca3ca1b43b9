"""Operator 8, quality classifier by Bradley-Terry pairwise ranking.

Preference pairs - a document labelled good and one labelled bad - teach a linear
score: the chance that the first is preferred is the logistic function of the
difference of the two scores, so the loss is logistic in feature differences.
Features come from the text alone: byte shares, hashed byte 3-grams and words,
and a few word statistics. The score's cut is a quantile of the training scores,
the one that accepts as many documents as are labelled good; scores are mapped
to 0..1 by a calibrated logistic curve that puts the cut at ``threshold``.

Every labelled row teaches, but rows whose id's CRC is divisible by 5. They are dealt
by a hash of their id to groups of about ``size`` rows; in a task, each group fits
weights on all pairs of its good and bad rows, and the weights of the groups are
averaged (one group: its own). Where one kind is too rare for every group to have
``RARE`` rows of it, its rows teach in several groups. Cut and curve come from the
scores that the averaged weights give all those rows. Scoring is one pass over all
whole texts, in Arrow batches, with no shuffle.

Edge cases: null and empty texts have no grams and get the score of their word
statistics; a null id counts as held out; with no labels, or only one kind, every
score is the share of good ones (0.5 without any); repeated rows get a row each;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import documents, map_texts, pinned
from concordat.llm.grams import Block, dot, profile
from concordat.llm.labelled import descend, feature_rows, fold, platt, scaling, sigmoid, training, unpacked

FAMILIES = {"c1": 8, "c3": 10, "w1": 10}
#: Buckets of all families, and the columns of ``statistics``.
BUCKETS = sum(1 << b for b in FAMILIES.values())
WIDTH = BUCKETS + 4
#: Rows of each kind that a group has at least, about.
RARE = 32
#: Pairs whose pull is held at once.
BLOCK_PAIRS = 1 << 20
#: Bins of scores in a step of one logit.
STEPS = 1000


def statistics(block: Block) -> np.ndarray:
    """Logarithm of the words, their mean length, shares of repeated words and of repeated word pairs."""
    words = np.maximum(block.words, 1)
    inside = np.bincount(block.doc, weights=block.end - block.begin, minlength=len(block.length))
    pairs, doc = block.windows(2)
    return np.column_stack([np.log1p(block.words), inside / words, block.repeats(block.hash, block.doc) / words,
                            block.repeats(pairs, doc) / words])


def features(texts: list[bytes]) -> np.ndarray:
    block = Block(texts)
    return np.concatenate([profile(block, FAMILIES), statistics(block)], axis=1)


def learn(x: np.ndarray, label: np.ndarray, steps: int = 200, decay: float = 1e-3) -> np.ndarray | None:
    """Weights of a group's rows, from all their pairs of a good and a bad one; None without any pair."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    pairs = len(good) * len(bad)
    if not pairs:
        return None
    scale = scaling(x)
    x *= scale  # in place: the rows are not needed as they were
    block = max(1, BLOCK_PAIRS // len(bad))

    def gradient(w):
        score = x @ w.astype(np.float32)
        by_doc = np.zeros(len(x))
        for at in range(0, len(good), block):
            a = good[at:at + block]
            pull = sigmoid(score[a][:, None] - score[bad]) - 1  # of each pair's loss in its score difference
            by_doc[a] = pull.sum(1, dtype=np.float64)
            by_doc[bad] -= pull.sum(0, dtype=np.float64)
        return x.T @ (by_doc / pairs).astype(np.float32) + decay * w

    return descend(gradient, x.shape[1], steps) * scale


def weights(rows: DataFrame, n_good: int, n_bad: int, size: int) -> np.ndarray:
    """The groups' weights, averaged; ``rows`` are (doc_id, label, features)."""
    groups = max(1, -(-(n_good + n_bad) // size))
    copies = {1: min(groups, -(-groups * RARE // n_good)), 0: min(groups, -(-groups * RARE // n_bad))}
    times = F.when(F.col("label") == 1, copies[1]).otherwise(copies[0])
    dealt = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), times - 1))).withColumn(
        "_group", F.pmod(F.xxhash64(F.lit(17), "doc_id") + F.col("_copy"), F.lit(groups)).cast("int")).drop("_copy")

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        x = unpacked(table.column("features"), WIDTH)
        w = learn(x, table.column("label").to_numpy())
        found = [] if w is None else [w.tolist()]
        return pa.table({"_group": table.column("_group")[:len(found)], "w": pa.array(found, pa.list_(pa.float64()))})

    fitted = dealt.groupBy("_group").applyInArrow(fit, "_group int, w array<double>")
    ordered = F.array_sort(F.collect_list(F.struct("_group", "value")))  # sums in one order: reruns agree
    mean = F.aggregate(ordered, F.lit(0.0), lambda s, v: s + v["value"]) / F.count("*")
    got = fitted.select("_group", F.posexplode("w").alias("pos", "value")).groupBy("pos").agg(mean.alias("w")).toArrow()
    return got.sort_by("pos").column("w").to_numpy()


def curve(known: DataFrame, n_good: int, n_bad: int, threshold: float) -> tuple[float, float]:
    """Slope and offset of the logistic curve over ``known`` (label, raw) that is ``threshold`` at the cut."""
    counts = known.groupBy(F.floor(F.col("raw") * STEPS).alias("bin")).agg(
        F.count_if(F.col("label") == 1).alias("good"), F.count("*").alias("all")).toArrow().sort_by("bin")
    bins, good, every = (counts.column(c).to_numpy() for c in ("bin", "good", "all"))
    # The quantile lies between two neighbours in the order of all scores: only their bins' scores are looked at.
    at = n_bad / (n_good + n_bad) * (n_good + n_bad - 1)
    first, last = np.searchsorted(np.cumsum(every), [int(at), int(np.ceil(at))], "right")
    below, inside = int(every[:first].sum()), int(every[first:last + 1].sum())
    near = known.where(F.floor(F.col("raw") * STEPS).between(int(bins[first]), int(bins[last])))
    cut = near.agg(F.percentile("raw", F.lit(float(np.clip((at - below) / max(inside - 1, 1), 0, 1)))).alias("cut")).toArrow().column("cut")[0].as_py()
    middle = (bins + 0.5) / STEPS
    slope, _ = platt(np.concatenate([middle, middle]), np.repeat([1.0, 0.0], len(bins)), weight=np.concatenate([good, every - good]))
    return slope, float(np.log(threshold / (1 - threshold)) - slope * cut)


def rank(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, size: int = 4000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; see the module's text."""
    known = pinned(training(labels, label).join(docs.select("doc_id"), "doc_id", "left_semi"))
    found = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    n_good, n_bad = found.get(1.0, 0), found.get(0.0, 0)
    held_out = (fold("doc_id") == 0).alias("held_out")
    if not n_good or not n_bad:
        share = n_good / (n_good + n_bad) if n_good + n_bad else 0.5
        scored, score = docs, F.lit(share)
    else:
        w = weights(feature_rows(docs, known, features), n_good, n_bad, size)

        def work(texts: list[bytes]) -> dict:
            block = Block(texts)
            return {"raw": pa.array(dot(block, FAMILIES, w[:BUCKETS]) + statistics(block) @ w[BUCKETS:])}

        scored = pinned(map_texts(docs, "raw double", work))
        taught = scored.join(known, "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("raw").alias("raw"))
        slope, offset = curve(pinned(taught.select("label", "raw")), n_good, n_bad, threshold)
        z = F.greatest(F.lit(-35.0), F.least(F.lit(35.0), F.col("raw") * slope + offset))
        score = 1 / (1 + F.exp(-z))
    return scored.select("doc_id", held_out, score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def op8_quality_rank(spark, sf_dir):
    return rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op8_quality_rank": op8_quality_rank}
