"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a group-by with map-side combine and a join on the node, so a
node with very many links is split like any skewed join; no component meets
in one task and nothing but two sums reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import pinned


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on ``edges`` (a > b). Large: neighbours above a node link to the least of all. Small: those below do."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        made = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        made = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return made.where("a > b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node links straight to the least of its component, so that a step would change nothing."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")),
                                          F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    per_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return not per_node.agg(F.max((F.col("up") > 0) & (F.col("n") > 1))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each linked node's component. ``edges`` has long columns a and b.

    Nodes without a link to another node are not listed. Direction, repeats
    and self-links of the input don't matter; an empty input gives no rows.
    """
    edges = pinned(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _settled(edges):
        edges = pinned(_star(_star(edges, large=True), large=False))
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)


def between_roots(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) that lie between different components of ``roots`` (as ``components`` gives them), with their
    roots l and m; a node that ``roots`` does not list is its own."""
    for end, name in (("a", "l"), ("b", "m")):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(name)), end, "left").withColumn(
            name, F.coalesce(name, end))
    return pairs.where("l <> m")


def extended(roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """``roots`` after the links ``pairs`` (a, b) are added: only links between different components are followed, one
    for every two of them, so those within a group, which may be as many as its nodes squared, cost no step."""
    up = pinned(components(between_roots(pairs, roots).select(F.col("l").alias("a"), F.col("m").alias("b"))))
    moved = roots.join(up.select(F.col("node").alias("root"), F.col("root").alias("_r")), "root", "left").select(
        "node", F.coalesce("_r", "root").alias("root"))
    return pinned(moved.unionAll(up.join(roots, "node", "left_anti").select("node", "root")))


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (row numbers) after joining the components of rows ``i`` and ``j``."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        up = np.arange(len(label))
        np.minimum.at(up, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
