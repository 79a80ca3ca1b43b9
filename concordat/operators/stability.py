"""Repeated-score statistics: stability per group, confidence curves, histograms."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.functions.text import as_col
from concordat.operators.running import running_totals

# T quantile used for every 95 % interval; deviation and KS limits.
T_95 = 2.262
KS_LIMIT = 0.05
# Terms of the Kolmogorov series; later ones are below 1e-12 for every distance that is not certain to pass.
KS_TERMS = 100
DEVIATION_LIMIT = 0.15

# Score category names, and what is removed before matching them.
CATEGORIES = ("population time-series", "trait data", "abundances", "presence/absence", "plots", "specimens",
              "museum collection", "trajectory")
CATEGORY_NOISE = (" ", "-", "_", ".", "/", "s", "data")


def strip_category(value: Column | str) -> Column:
    out = F.lower(as_col(value))
    for noise in CATEGORY_NOISE:
        out = F.replace(out, F.lit(noise), F.lit(""))
    return out


def clean_category(value: Column | str) -> Column:
    """Canonical category, or a light cleanup of an unknown one."""
    v = as_col(value)
    out = F.btrim(F.rtrim(F.replace(F.translate(F.lower(v), "_-", "  "), F.lit("data"), F.lit("")), F.lit("s")))
    for name in reversed(CATEGORIES):
        key = name
        for noise in CATEGORY_NOISE:
            key = key.replace(noise, "")
        out = F.when(strip_category(v) == key, name).otherwise(out)
    return out


def is_unlisted_category(value: Column | str) -> Column:
    return ~F.lower(as_col(value)).isin(*CATEGORIES)


def first_n_per_key(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """At most ``n`` rows per key. The rank limit is applied per task before
    the shuffle (WindowGroupLimit), so a hot key sends ``n`` rows per task."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def ks_distance(df: DataFrame, keys: list[str], score: str, *, slices: int | None = None) -> DataFrame:
    """Kolmogorov-Smirnov distance of each group's scores from Uniform(0, 1).

    Equal scores are counted together first (partial aggregation), then the
    cumulative counts come from sliced running totals, so a group that holds a
    third of all rows is neither sorted nor kept in one task.
    """
    counted = df.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_c"))
    sizes = df.filter(F.col(score).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    running = running_totals(counted, [(score, False)], {"_cum": F.col("_c")}, keys=keys, slices=slices)
    x = F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0))
    joined = running.join(sizes, keys)
    above = F.col("_cum") / F.col("n") - x
    below = x - (F.col("_cum") - F.col("_c")) / F.col("n")
    return joined.groupBy(*keys).agg(F.max(F.greatest(above, below)).alias("ks_d"), F.max("n").alias("n"))


def _exact_p(n: int, d: float) -> float:
    """Two-sided p-value of the KS distance, by the matrix recursion of Marsaglia, Tsang and Wang (2003).

    Its work grows with the cube of n d.
    """
    import numpy as np

    if d <= 0:
        return 1.0
    if d >= 1:
        return 0.0
    k = int(n * d) + 1
    m = 2 * k - 1
    h = k - n * d
    grid = np.zeros((m, m))
    for i in range(m):
        grid[i, : min(m, i + 2)] = 1.0
    powers = h ** np.arange(1, m + 1)
    grid[:, 0] -= powers
    grid[m - 1, :] -= powers[::-1]
    grid[m - 1, 0] += max(0.0, 2 * h - 1) ** m
    factorials = np.cumprod(np.r_[1.0, np.arange(1, m + 1)])
    for i in range(m):
        for j in range(min(m, i + 2)):
            if i - j + 1 > 0:
                grid[i, j] /= factorials[i - j + 1]
    power = np.linalg.matrix_power(grid, n)
    log_scale = np.sum(np.log(np.arange(1, n + 1))) - n * np.log(n)
    return float(min(1.0, max(0.0, 1.0 - power[k - 1, k - 1] * np.exp(log_scale))))


@F.arrow_udf(T.DoubleType())
def _exact_p_values(n: pa.Array, d: pa.Array) -> pa.Array:
    pairs = zip(n.to_pylist(), d.to_pylist())
    return pa.array([None if a is None or b is None else _exact_p(a, b) for a, b in pairs], pa.float64())


def ks_p_value(n: Column, d: Column, method: str = "asymptotic") -> Column:
    """Two-sided p-value of the KS distance ``d`` of ``n`` scores; the caller chooses how, whatever n is.

    ``asymptotic``: Kolmogorov's series (terms below 1e-12 left out) with the
    Stephens correction, in the JVM. ``exact``: the matrix recursion.
    """
    if method == "exact":
        return _exact_p_values(n, d)
    if method != "asymptotic":
        raise ValueError(f"unknown method {method!r}")
    root = F.sqrt(n.cast("double"))
    lam = (root + 0.12 + 0.11 / root) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0), lambda total, j: total + F.when(
        j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * lam * lam))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series))
    return F.when(d.isNull() | n.isNull(), None).when(d <= 0, 1.0).when(d >= 1, 0.0).otherwise(p)


def score_stability(df: DataFrame, keys: list[str], score: str, *, with_p_value: bool = False,
                    method: str = "asymptotic") -> DataFrame:
    """Per group: count, mean, sample deviation, KS distance and a t interval."""
    moments = df.groupBy(*keys).agg(F.count(score).alias("_n"), F.avg(score).alias("average"),
                                    F.stddev_samp(score).alias("std"))
    out = moments.join(ks_distance(df, keys, score), keys).drop("_n")
    half = T_95 * F.col("std") / F.sqrt("n")
    out = out.withColumns({"ci_lower_95": F.col("average") - half, "ci_upper_95": F.col("average") + half})
    return out.withColumn("ks_p_value", ks_p_value(F.col("n"), F.col("ks_d"), method)) if with_p_value else out


def deviation_flags(df: DataFrame, keys: list[str], score: str, limit: float = DEVIATION_LIMIT) -> DataFrame:
    """Distance of every score from its group mean, and whether it is within the limit.

    The mean is a partially aggregated table joined back (AQE splits a hot
    key), not a window that would hold the group in one task.
    """
    means = df.groupBy(*keys).agg(F.avg(score).alias("dist_average"))
    joined = df.join(means, keys, "left")
    return joined.withColumn("deviation", F.abs(F.col(score) - F.col("dist_average"))).withColumn(
        "within_limit", F.col("deviation") <= limit)


def confidence_curve(df: DataFrame, score: str, tie_breaker: str, hit: Column, mask: Column | None = None, *,
                     slices: int | None = None) -> DataFrame:
    """Share of hits among all rows scored at least as high, best score first.

    With ``mask`` a second curve runs over the masked rows only and keeps its
    last value on the rows in between (NULL before the first masked row).
    """
    order = [(score, True), (tie_breaker, False)]
    as_int = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    sums = {"rows_so_far": F.lit(1).cast("bigint"), "hits_so_far": as_int(hit)}
    if mask is not None:
        sums |= {"masked_rows": as_int(mask), "masked_hits": as_int(mask & hit)}
    out = running_totals(df, order, sums, slices=slices)
    out = out.withColumn("confidence", F.col("hits_so_far") / F.col("rows_so_far"))
    if mask is not None:
        out = out.withColumn("confidence_masked", F.try_divide("masked_hits", "masked_rows"))
    return out


def score_histogram(df: DataFrame, score: str, edges: list[float]) -> DataFrame:
    """Counts in half-open bins [edge, next edge) and at or above each edge.

    All bins are counted in one aggregation; the result has one row per edge,
    highest first in ``counts_from_top``. The last edge opens no bin.
    """
    s = F.col(score)
    sums = []
    for i, edge in enumerate(edges):
        inside = (s >= edge) & (s < edges[i + 1]) if i + 1 < len(edges) else F.lit(False)
        sums += [F.count_if(inside).alias(f"b{i}"), F.count_if((s >= edge) & F.lit(i + 1 < len(edges))).alias(f"c{i}")]
    totals = df.agg(*sums)
    rows = [F.struct(F.lit(edge).alias("edge"), F.col(f"b{i}").alias("count"), F.col(f"c{i}").alias("at_or_above"),
                     sum((F.col(f"b{j}") for j in range(i + 1, len(edges))), F.col(f"b{i}")).alias("counts_from_top"))
            for i, edge in enumerate(edges)]
    return totals.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Count and share per value. The total is a global sum over the already
    counted values' aggregate, so nothing row-level meets in one task."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def counts_with_default(df: DataFrame, value: Column, default: str = "None") -> DataFrame:
    return df.groupBy(F.coalesce(value.cast("string"), F.lit(default)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and exact linear quartiles.

    Quartiles are read off the running counts of the distinct values, which are
    range-partitioned: no group's values meet in one task or buffer.
    """
    by = by or []
    c = F.col(column)
    group = by or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    moments = rows.groupBy(*group).agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                                       F.min(c).alias("min"), F.max(c).alias("max"))
    counted = rows.filter(c.isNotNull()).groupBy(*group, c.alias("_value")).agg(F.count(F.lit(1)).alias("_c"))
    running = running_totals(counted, [("_value", False)], {"_upto": F.col("_c")}, keys=group)
    # Rows at 0-based places floor(h) and ceil(h), h = (count - 1) q: the least value that more rows than that reach.
    sizes = moments.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("count").alias("_n"))
    same = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group])
    placed = running.join(sizes, same)
    at = {q: (F.col("_n") - 1) * q for q in (0.25, 0.5, 0.75)}
    edge = lambda h: F.min(F.when(F.col("_upto") > h, F.col("_value")))
    marks = placed.groupBy(*group).agg(*[x for q, h in at.items() for x in (
        edge(F.floor(h)).alias(f"_lo{q}"), edge(F.ceil(h)).alias(f"_hi{q}"))])
    marks = marks.select(*[F.col(g).alias(f"_g_{g}") for g in group], *[F.col(f"`{m}{q}`").alias(f"{m}_{i}")
                                                                       for i, q in enumerate(at) for m in ("_lo", "_hi")])
    joined = moments.join(marks, same, "left")
    out = {}
    for i, q in enumerate(at):
        h = (F.col("count") - 1) * q
        out[("q25", "q50", "q75")[i]] = F.col(f"_lo_{i}") + (h - F.floor(h)) * (F.col(f"_hi_{i}") - F.col(f"_lo_{i}"))
    return joined.withColumns(out).select(*by, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def labels_over(scores: Column, threshold: float = 0.8) -> Column:
    """Names in a score map that reach the threshold, sorted."""
    return F.array_sort(F.map_keys(F.map_filter(scores, lambda _, v: v >= threshold)))
