"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator on documents."""

import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from concordat.llm import (embedding_dedup, mixing, packing, quality_rank, quality_rules, secret_scan, sharding, simhash,
                           token_counts, url_filter)
from concordat.llm.common import SHUFFLE_CLEANUP, pinned

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "end"
ROWS = [(1, "Alpha beta gamma delta.", "en", "a", 23), (2, None, "en", "a", None), (3, "", None, None, 0),
        (4, "alpha BETA gamma delta.", "de", "b", 23), (4, "alpha BETA gamma delta.", "de", "b", 23),
        (None, "alone and without a number", "en", "b", 26), (6, LONG, "en", None, len(LONG)), (7, "\n \t", "fr", "c", 3),
        (8, "é ü 漢字 <|endoftext|> \U0001f600", None, "a", 26)]
CLASHES = ("size", "shard", "score", "component_id", "fp", "new", "number", "class", "task", "_row", "_text", "label", "kept")
OPERATORS = {
    "simhash": lambda d, y: simhash.near_duplicates(d), "packing": lambda d, y: packing.pack(d),
    "token_counts": lambda d, y: token_counts.token_counts(d), "secret_scan": lambda d, y: secret_scan.secrets(d),
    "sharding": lambda d, y: sharding.shard(d), "mixing": lambda d, y: mixing.mix(d),
    "quality_rank": quality_rank.rank, "quality_rules": quality_rules.rules}


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(docs, labels, name):
    got = Counter(r["doc_id"] for r in OPERATORS[name](docs, labels).collect())
    want = Counter(r[0] for r in ROWS)
    if name == "packing":  # a long text is cut
        got, want = set(got), set(want)
    assert got == want


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, labels, name):
    empty = spark.createDataFrame([], SCHEMA)
    assert OPERATORS[name](empty, labels.where("false")).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_return_the_columns_of_documents(spark, docs, labels, tmp_path, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for df in (spark.createDataFrame(ROWS, SCHEMA), docs, docs.where("false")):
        out = corpus_pipeline.STAGES[stage][1](spark, df, str(tmp_path))
        rows = out.collect()
        if stage == 4:  # the last one returns pieces
            assert {r["doc_id"] for r in rows} == {r[0] for r in ROWS if rows}
            continue
        assert out.columns == df.columns
        if stage == 1 and len(df.columns) == 5 and rows:
            assert Counter(r["doc_id"] for r in rows) == {1: 1, 2: 1, None: 1, 6: 1, 8: 1}  # 4 says what 1 says, 3 and 7 what 2 does
        if stage == 2 and rows:
            assert len(rows) == len(ROWS)


def test_null_and_empty_texts(docs, labels):
    fp = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert fp[2]["fingerprint"] == fp[3]["fingerprint"] == fp[7]["fingerprint"] == "0" * 16
    assert {fp[i]["component_id"] for i in (2, 3, 7)} == {2} and fp[1]["component_id"] == fp[4]["component_id"] == 1
    counted = {r["doc_id"]: r for r in token_counts.token_counts(docs).collect()}
    assert counted[2]["n_tokens"] == counted[3]["n_bytes"] == 0 and counted[6]["over_limit"]
    sized = {r["doc_id"]: r for r in sharding.shard(docs).collect()}
    assert sized[2]["size"] == sized[3]["size"] == 1 and sized[2]["text_crc32"] == 0
    judged = {r["doc_id"]: r for r in quality_rules.rules(docs, labels).collect()}
    assert judged[2]["base_failed"] and judged[3]["n_words"] == 0 and not judged[2]["kept"]
    assert judged[6]["n_repeat_words"] == 30_000 and judged[6]["base_failed"]


def test_pages(spark):
    rows = [(1, None), (2, "no scheme"), (3, ""), (4, "http://www.Example.COM/en/x"), (4, "http://www.Example.COM/en/x"),
            (None, "http://a.net/es/1?b=c")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "features", "label")})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert got[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[None][2:] == ("net/es/", "block")
    assert all(got[i][:3] == ("", "", None) and got[i][3] in ("allow", "block") for i in (1, 2, 3))
    assert url_filter.judge(pages.where("false")).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages.where("page_id = 4")).collect()} == {"allow"}


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.01], 1), (4, [0.0, 0.0], 1), (5, None, 1),
            (6, [1.0, None], 1), (7, [float("nan"), 1.0], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 2), (10, [1.0], 1),
            (11, [float("inf"), 1.0], 1), (None, [0.0, 1.0], 1), (12, [1e300, 0.0], 3), (13, [1e-300, 0.0], 3)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(0))
    got = {}
    for r in embedding_dedup.near_duplicates(vectors).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert got[1] == [(3, 1, True)] and got[2] == [(3, 1, False)] * 2 and got[3] == [(3, 1, False)]
    assert all(got[i] == [(0, i, True)] for i in (4, 5, 6, 7, 8, 9, 10, 11))
    assert got[12] == [(1, 12, True)] and got[13] == [(1, 12, False)] and got[None] == [(0, None, False)]
    assert embedding_dedup.near_duplicates(vectors.where("false")).count() == 0


def test_pinned_rows_leave_no_shuffle_files(spark):
    folder = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    files = lambda: {p.name for p in folder.rglob("shuffle_*.data")}
    before = files()
    rows = pinned(spark.range(50_000).groupBy((F.col("id") % 10_000).alias("k")).count())
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert rows.count() == 10_000 and rows.agg(F.sum("count")).first()[0] == 50_000
    assert spark.conf.get(SHUFFLE_CLEANUP, None) is None
