"""Sharding and mixing: their laws, on the test tables and with a source and a text that hold a third of the rows."""

import re
from collections import defaultdict

import numpy as np
import pytest

from concordat.llm import mixing, sharding

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def hot(spark):
    draw = np.random.default_rng(1)
    rows = [(i, "same text again" if i % 3 == 0 else "w " * int(draw.integers(1, 400)) + str(i), "en",
             "hot" if i % 3 else f"s{i % 20}", None) for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


@pytest.mark.parametrize("shards", (16, 5, 1))
def test_shards(spark, hot, shards):
    got = sharding.shard(hot, shards).toPandas()
    bytes_by = got.groupby("shard")["size"].sum()
    assert len(got) == 3000 and sorted(bytes_by.index) == list(range(shards))
    assert bytes_by.max() < 1.05 * bytes_by.mean() and bytes_by.min() > 0.95 * bytes_by.mean()
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])


def test_shard_query(spark):
    df = sharding.op6_sharding(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    got = df.toPandas()
    assert got["doc_id"].is_unique and got["grown_shard"].isna().all() and set(got["law"]) == {"bytes"}
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() < 1.1 * sums.mean()


def test_targets_share_the_excess():
    assert mixing.targets([10, 1000, 1000], 1.5, 2) == pytest.approx([20, 2995 / 3, 5990 / 3])
    assert mixing.targets([], 1.5, 2) == [] and mixing.targets([0, 0], 1.5, 2) == [0, 0]


def test_seats_go_by_highest_quotients():
    draw = np.random.default_rng(2)
    for _ in range(30):
        claims = draw.random(6) * 100
        most = draw.integers(1, 40, 6).tolist()
        seats = int(draw.integers(0, sum(most)))
        want = [0] * 6
        for _ in range(seats):
            i = max((k for k in range(6) if want[k] < most[k]), key=lambda k: (claims[k] / (2 * want[k] + 1), -k))
            want[i] += 1
        assert mixing.sainte_lague(seats, claims.tolist(), most) == want


def test_taken_words_are_those_of_the_blocks(hot):
    for r in mixing.plan(hot).collect():
        parts = mixing.parts_taken(*(r[c] for c in ("_place", "size", "_blocks", "_rest", "_start", "_block")))
        assert r["taken"] == r["_whole"] * r["size"] + sum(b - a for a, b in parts)


def test_mix_query(spark):
    got = mixing.op7_mixing(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    both = got.merge(docs, on="doc_id")
    assert (both["size"] == both["text"].map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))).all()
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] >= 0).all()
    names = sorted(docs["source"].unique())
    want = mixing.targets([int(both.loc[both["source"] == s, "size"].sum()) for s in names], 1.5, 2)
    for s, t in zip(names, want):
        mine = both[both["source"] == s]
        assert (mine["source_size"] == mine["size"].sum()).all() and np.allclose(mine["target"], t)
        assert abs(mine["taken"].sum() - t) <= 0.01 * t


def test_reruns_agree_whatever_the_layout(spark, hot):
    one = mixing.mix(hot).toPandas().sort_values("doc_id").reset_index(drop=True)
    two = mixing.mix(hot.repartition(3, "n_chars").sortWithinPartitions("text")).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert one.equals(two)


def test_mixed_rows_hold_the_taken_words(hot):
    taken = defaultdict(int)
    for r in mixing.mix(hot).collect():
        taken[r["doc_id"]] += r["taken"]
    words = defaultdict(int)
    for r in mixing.mixed(hot).collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert words == {k: v for k, v in taken.items() if v}


def test_a_tiny_source_does_not_shred_the_others(spark):
    big = " ".join(f"w{i}" for i in range(5000))
    rows = [(i, f"d{i} {big}", "en", "big", None) for i in range(40)] + [(99, "a few words only", "en", "tiny", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.plan(docs).collect()
    assert {r["_block"] for r in got if r["doc_id"] != 99} == {1024} and {r["_block"] for r in got if r["doc_id"] == 99} == {1}
    large = [r for r in got if r["doc_id"] != 99]
    assert abs(sum(r["taken"] for r in large) - large[0]["target"]) <= 0.01 * large[0]["target"]
    pieces = [len(r["text"].splitlines()) for r in mixing.mixed(docs).where("source = 'big'").collect()]
    assert max(pieces) <= 6
