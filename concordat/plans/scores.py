"""Score-stability queries over ``events`` (users score event types repeatedly)."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat.operators import stability as st
from concordat.plans.base import derived, plain, table

SCORES = """SELECT event_id, user_id, event_type, value / 200.0 - floor(value / 200.0) AS score, user_id % 4 = 0 AS hallucinated,
  CASE event_id % 5 WHEN 0 THEN 'Trait_Data' WHEN 1 THEN 'abundance' WHEN 2 THEN 'Population time series' WHEN 3 THEN 'Plot' ELSE event_type END AS category FROM {events}"""


def _scores(spark, sf):
    return derived(spark, sf, SCORES)


def first_n_runs(spark, sf):
    kept = st.first_n_per_key(_scores(spark, sf), "user_id", [F.col("event_id")], 10)
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))


def score_stability(spark, sf):
    out = st.score_stability(_scores(spark, sf), ["user_id", "event_type"], "score")
    return out.select("user_id", "event_type", "n", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("average", "std", "ks_d", "ci_lower_95", "ci_upper_95")])


def score_stability_p(spark, sf):
    """With the asymptotic KS p-value: significant groups per event type."""
    out = st.score_stability(_scores(spark, sf), ["user_id", "event_type"], "score", with_p_value=True)
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("ks_p_value") <= st.KS_LIMIT).alias("deterministic"))


def confidence_curve(spark, sf):
    flagged = st.deviation_flags(_scores(spark, sf), ["event_type"], "score")
    curve = st.confidence_curve(flagged, "score", "event_id", F.col("within_limit"), ~F.col("hallucinated"))
    return curve.select("event_id", "rows_so_far", "hits_so_far", F.round("confidence", 6).alias("confidence"), F.round("confidence_masked", 6).alias("masked"))


def score_histogram(spark, sf):
    return st.score_histogram(_scores(spark, sf), "score", [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])


def category_shares(spark, sf):
    cleaned = _scores(spark, sf).select(st.clean_category("category").alias("category"), st.is_unlisted_category("category").alias("unlisted"))
    return st.value_shares(cleaned, "category").withColumn("share", F.round("share", 6))


def year_counts(spark, sf):
    o = table(spark, sf, "orders")
    return st.counts_with_default(o, F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")))


def score_describe(spark, sf):
    d = st.describe(_scores(spark, sf), "score", ["event_type"])
    return d.select("event_type", "count", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


def labels_over_threshold(spark, sf):
    """Categories with a score of at least 0.8, per user."""
    top = _scores(spark, sf).groupBy("user_id", "event_type").agg(F.max("score").alias("m")).groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("event_type", "m"))).alias("scores"))  # at most one entry per event type
    return top.select("user_id", F.array_join(st.labels_over(F.col("scores")), ",").alias("labels"))


_S = f"WITH s AS ({plain(SCORES)})"

QUERIES = {f.__name__: f for f in (first_n_runs, score_stability, score_stability_p, confidence_curve, score_histogram, category_shares, year_counts,
                                   score_describe, labels_over_threshold)}

ORACLE = {
    "first_n_runs": _S + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM s)
      SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM r WHERE rn <= 10 GROUP BY 1""",
    "score_stability": _S + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY score) AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM s),
      g AS (SELECT user_id, event_type, count(*) AS n, avg(score) AS average, stddev_samp(score) AS std, max(greatest(i / n - score, score - (i - 1) / n)) AS ks_d FROM r GROUP BY 1, 2)
      SELECT user_id, event_type, n, round(average + 1e-9, 6) AS average, round(std + 1e-9, 6) AS std, round(ks_d + 1e-9, 6) AS ks_d, round(average - 2.262 * std / sqrt(n) + 1e-9, 6) AS ci_lower_95,
      round(average + 2.262 * std / sqrt(n) + 1e-9, 6) AS ci_upper_95 FROM g""",
    "score_stability_p": _S + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY score) AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM s),
      g AS (SELECT user_id, event_type, count(*) AS n, max(greatest(i / n - score, score - (i - 1) / n)) AS d FROM r GROUP BY 1, 2),
      l AS (SELECT *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d AS lam FROM g),
      p AS (SELECT user_id, l.event_type, any_value(d) AS d, greatest(0.0, least(1.0, 2 * sum(CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * j * j * lam * lam)))) AS p FROM l, range(1, 101) t(j) GROUP BY 1, 2)
      SELECT event_type, count(*) AS groups, count(*) FILTER (CASE WHEN d <= 0 THEN 1.0 WHEN d >= 1 THEN 0.0 ELSE p END <= 0.05) AS deterministic FROM p GROUP BY 1""",
    "confidence_curve": _S + """, a AS (SELECT event_type, avg(score) AS m FROM s GROUP BY 1), f AS (SELECT event_id, score, hallucinated, abs(score - m) <= 0.15 AS hit FROM s JOIN a USING (event_type)),
      c AS (SELECT event_id, count(*) OVER w AS rows_so_far, count(*) FILTER (hit) OVER w AS hits_so_far, count(*) FILTER (NOT hallucinated) OVER w AS mr,
        count(*) FILTER (NOT hallucinated AND hit) OVER w AS mh FROM f WINDOW w AS (ORDER BY score DESC, event_id ROWS UNBOUNDED PRECEDING))
      SELECT event_id, rows_so_far, hits_so_far, round(hits_so_far / rows_so_far, 6) AS confidence, round(mh / nullif(mr, 0), 6) AS masked FROM c""",
    "score_histogram": _S + """, e AS (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]) AS edge, unnest([0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, NULL]::DOUBLE[]) AS nxt)
      SELECT edge, count(*) FILTER (score >= edge AND score < nxt) AS "count", count(*) FILTER (score >= edge AND nxt IS NOT NULL) AS at_or_above,
      count(*) FILTER (score >= edge AND score < 1.0) AS counts_from_top FROM e, s GROUP BY edge, nxt""",
    "category_shares": _S + """, c AS (SELECT CASE WHEN category = 'Trait_Data' THEN 'trait data' WHEN category = 'abundance' THEN 'abundances' WHEN category = 'Population time series' THEN 'population time-series'
      WHEN category = 'Plot' THEN 'plots' ELSE trim(rtrim(category, 's')) END AS category FROM s) SELECT category, count(*) AS n, round(count(*) / (SELECT count(*) FROM c), 6) AS share FROM c GROUP BY category""",
    "year_counts": "SELECT coalesce(CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS VARCHAR) END, 'None') AS value, count(*) AS n FROM orders GROUP BY 1",
    "score_describe": _S + """ SELECT event_type, count(score) AS "count", round(avg(score) + 1e-9, 6) AS mean, round(stddev_samp(score) + 1e-9, 6) AS std, round(min(score) + 1e-9, 6) AS min, round(quantile_cont(score, 0.25) + 1e-9, 6) AS q25,
      round(quantile_cont(score, 0.5) + 1e-9, 6) AS q50, round(quantile_cont(score, 0.75) + 1e-9, 6) AS q75, round(max(score) + 1e-9, 6) AS max FROM s GROUP BY 1""",
    "labels_over_threshold": _S + """, g AS (SELECT user_id, event_type, max(score) AS m FROM s GROUP BY 1, 2)
      SELECT user_id, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (m >= 0.8), '') AS labels FROM g GROUP BY 1""",
}
