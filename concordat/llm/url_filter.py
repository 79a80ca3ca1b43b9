"""Operator 4, URL filter: host and path rules, then gradient-boosted trees on lexical features.

Rules decide the urls they fit (longest rule first). The urls they decide are
the labelled ones: boosted trees learn allow or block from lexical features -
lengths, depth, digit ratio, entropy, parameter counts, punctuation, and how
often urls with the same host suffix are blocked - and judge all other urls.

The trees are fitted on at most ``bound`` labelled rows (those with the smallest
hash of their url); suffix statistics are counted over all rows. Features and
trees run in the JVM, row by row, and the html column is never read.

Edge cases: a null url, or one without ``://``, has empty host and path, fits no
rule and is judged by its features; an empty table gives no rows. If the rules
label no url, or all alike, there is nothing to learn: the rest is allowed, or
gets the one verdict seen. Repeated rows get a row each; extra columns are
ignored.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import bounded_sample, pinned

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/"))
FEATURES = ("n_url", "n_host", "n_path", "depth", "dots", "hyphens", "digits", "entropy", "params", "fragment", "port",
            "p_block", "n_suffix")


def split_url(pages: DataFrame) -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path`` to (page_id, url)."""
    at = F.coalesce(F.locate("://", "url"), F.lit(0))
    rest = F.when(at > 0, F.substring("url", at + 3, F.length("url"))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return pages.withColumn("host", F.translate(raw, ascii_uppercase, ascii_lowercase)).withColumn(
        "path", F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length("url")), r"^[^?#]*", 0)).fillna("", ["host", "path"])


def matched(rules: tuple[tuple[str, str], ...], result: int) -> Column:
    """The longest fitting rule (``result`` 1) or its verdict (0)."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, tail = rule[1].partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + tail)
        out = F.when(fits, F.lit(rule[result])).otherwise(out)
    return out


def lexical(pages: DataFrame) -> DataFrame:
    """Add the features that a url has by itself, and its host suffix."""
    url = F.coalesce("url", F.lit(""))
    n = F.length(url)
    count = lambda text, char: (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("double")
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0),
                          lambda s, c: s - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    return pages.withColumns({
        "n_url": n.cast("double"), "n_host": F.length("host").cast("double"), "n_path": F.length("path").cast("double"),
        "depth": count(F.col("path"), "/"), "dots": count(F.col("host"), "."), "hyphens": count(url, "-"),
        "digits": F.when(n > 0, F.length(F.regexp_replace(url, "[^0-9]", "")) / n).otherwise(0.0),
        "entropy": F.when(n > 0, entropy).otherwise(0.0), "params": count(url, "&") + count(url, "="),
        "fragment": F.contains(url, F.lit("#")).cast("double"), "port": F.col("host").rlike(r":\d+$").cast("double"),
        "suffix": F.element_at(F.split("host", r"\."), -1)})


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, bound: int = 20_000, trees: int = 15,
          depth: int = 4, seed: int = 7) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block) of every page; see the module's text."""
    lines = split_url(pages.select("page_id", "url")).withColumns({"rule": matched(rules, 1), "ruled": matched(rules, 0)})
    lines = pinned(lexical(lines))
    blocked = (F.col("ruled") == "block").cast("double")
    known = lines.agg(F.count("ruled"), F.sum(blocked)).first()
    rate = (known[1] or 0.0) / known[0] if known[0] else 0.0
    columns = ["page_id", "host", "path", "rule"]
    if rate in (0.0, 1.0):
        other = F.lit("block" if known[0] and rate == 1.0 else "allow")
        return lines.select(*columns, F.coalesce("ruled", other).alias("verdict"), F.lit(rate).alias("p_block"))
    # Shares with one prior url, so a suffix that no rule decides has the overall share.
    stats = lines.groupBy(F.col("suffix").alias("_suffix")).agg(
        ((F.coalesce(F.sum(blocked), F.lit(0.0)) + rate) / (F.count("ruled") + 1)).alias("p_block"),
        F.log1p(F.count("*")).alias("n_suffix"))
    wide = lines.join(stats, F.col("suffix") == F.col("_suffix"), "left").fillna(0.0, ["p_block", "n_suffix"])
    wide = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(wide)
    taught = bounded_sample(wide.where("ruled is not null").select("url", "features", blocked.alias("label")), "url", bound)
    taught = pinned(taught)
    if taught.agg(F.countDistinct("label")).first()[0] < 2:  # a bound so small that one verdict is not in it
        guess = wide.withColumn("prediction", F.lit(float(rate >= 0.5))).withColumn("score", F.lit(rate))
    else:
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, cacheNodeIds=False).fit(taught)
        guess = model.transform(wide).withColumn("score", vector_item("probability"))
    by_model = F.when(F.col("prediction") == 1, "block").otherwise("allow")
    return guess.select(*columns, F.coalesce("ruled", by_model).alias("verdict"), F.col("score").alias("p_block"))


def vector_item(column: str) -> Column:
    """Second component of a vector column, in the JVM."""
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(column))[1]


def op4_url_filter(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op4_url_filter": op4_url_filter}
