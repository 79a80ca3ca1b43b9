"""Name lists matched by a join, and running totals that move rows once."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from concordat.functions.similarity import list_forms, renamed_set
from concordat.operators import mismatch, name_join
from concordat.operators.running import running_totals, slice_of


def lists(spark, seed, records=60, size=8):
    r = random.Random(seed)
    words = ["Tamias", "striatus", "striata", "wood", "turtle", "Glyptemys", "insculpta", "owl", "ß", "e"]
    def name():
        text = " ".join(r.choice(words) for _ in range(r.randint(1, 3)))
        if r.random() < .3:
            text = list(text)
            text[r.randrange(len(text))] = r.choice("aez")
            text = "".join(text)
        return f"{text} ({r.choice(words)} {r.choice(words)})" if r.random() < .3 else text
    some = lambda: [r.choice([name(), name(), ""]) for _ in range(r.randint(0, size))]
    return spark.createDataFrame([(i, some() if i % 9 else None, some() if i % 7 else None) for i in range(records)],
                                 "id int, truth array<string>, pred array<string>")


@pytest.mark.parametrize("aware", (False, True))
@pytest.mark.parametrize("threshold", (60, 80, 90, 96, 101))
def test_join_equals_the_match_in_the_row(spark, aware, threshold):
    df = lists(spark, threshold).withColumns({"t": list_forms(F.col("truth"), taxon_aware=aware), "p": list_forms(F.col("pred"), taxon_aware=aware)})
    df = df.repartition(3)
    by_row = dict(df.select("id", renamed_set(F.col("t"), F.col("p"), threshold).alias("set")).collect())
    for block in (512, 3):
        assert dict(name_join.renamed(df, "id", "t", "p", threshold, "set", block).select("id", "set").collect()) == by_row


def test_forms_are_not_made_again_by_a_filter(spark):
    df = lists(spark, 3).withColumns({"t": list_forms(F.col("truth"), taxon_aware=True), "p": list_forms(F.col("pred"), taxon_aware=True)})
    plan = name_join.candidates(df, "id", "t", "p", 101)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "transform(" in x]


def test_records_are_compared_once_for_the_recovery_summary(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def bucket(i):
        seen.add(1)
        return "ab"[i % 2]

    rows = spark.range(8).select("id", bucket.asNondeterministic()("id").alias("analysis_bucket"))  # as names are matched
    got = {r["analysis_bucket"]: r["share_of_species_mismatches"] for r in mismatch.recovery_summary(rows).collect()}
    assert got == {"a": 0.5, "b": 0.5} and seen.value == 8


def test_each_distinct_pair_is_scored_once(spark):
    df = lists(spark, 5).where("size(truth) > 0")
    df = df.select("id", "truth", "pred").unionAll(df.select(F.col("id") + 1000, "truth", "pred"))
    df = df.withColumns({"t": list_forms(F.col("truth"), taxon_aware=False), "p": list_forms(F.col("pred"), taxon_aware=False)})
    pairs = name_join.candidates(df, "id", "t", "p", 80)
    assert pairs.count() >= 2 * pairs.select("truth", "pred").distinct().count() > 0
    plan = name_join.scored(pairs, 80)._jdf.queryExecution().executedPlan().toString()
    calls = plan.split("ArrowEvalPython")
    assert len(calls) == 2 and "HashAggregate(keys=[truth" in calls[1].split("BatchScan")[0]


def test_bounds_lose_nothing_and_leave_little(spark):
    df = lists(spark, 8, 200).withColumns({"t": list_forms(F.col("truth"), taxon_aware=False), "p": list_forms(F.col("pred"), taxon_aware=False)})
    every = name_join.candidates(df, "id", "t", "p", 0)  # a threshold of 0 is always within reach
    left = name_join.candidates(df, "id", "t", "p", 85)
    hits = name_join.scored(every, 85).where("hit").select("id", "at", "place")
    assert hits.count() > 3 and hits.subtract(left.select("id", "at", "place")).isEmpty()
    assert left.count() < every.count() / 4


def test_a_long_list_is_spread_over_tasks(spark):
    # 10,000 names against 40 predictions in one record; block by block, not in one task.
    names = spark.range(10_000).select(F.concat(F.lit("species number "), (F.col("id") * 7919).cast("string")).alias("n"))
    truth = names.agg(F.collect_list("n").alias("truth"))
    pred = names.limit(40).agg(F.collect_list(F.concat("n", F.lit("x"))).alias("pred"))
    df = truth.crossJoin(pred).select(F.lit(1).alias("id"), list_forms(F.col("truth"), taxon_aware=False).alias("t"),
                                      list_forms(F.col("pred"), taxon_aware=False).alias("p"))
    pairs = name_join.candidates(df, "id", "t", "p", 96.5, block=256)
    spread = pairs.select(F.floor(F.col("place") / 256).alias("b")).distinct().count()
    assert spread > 1
    best = name_join.best_matches(df, "id", "t", "p", 96.5, block=256).collect()
    want = [r["n"] for r in names.limit(40).collect()]
    given = df.select("p").first()["p"]
    assert {given[r["at"]][0]: r["match"] for r in best} == {w + "x": w for w in want}


# ---- Running totals --------------------------------------------------------


@pytest.fixture(scope="module")
def numbers(spark):
    df = spark.range(0, 2000).select(
        "id", F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 10 < 7, "hot").otherwise((F.col("id") % 10).cast("string")).alias("k"),
        F.when(F.col("id") % 41 > 0, F.col("id") * 7919 % 300 / 7.0).alias("v"), F.lit("wide" * 50).alias("text"))
    return df.repartition(5)


@pytest.mark.parametrize("descending", (False, True))
@pytest.mark.parametrize("keys", ([], ["k"]))
def test_running_totals_equal_a_window(numbers, keys, descending):
    out = running_totals(numbers, [("v", descending), ("id", False)], {"s": F.col("id"), "n": F.lit(1), "nothing": F.lit(None).cast("long")},
                         keys=keys, slices=7)
    by = Window.partitionBy(*keys).orderBy(F.col("v").desc() if descending else F.col("v"), "id").rowsBetween(Window.unboundedPreceding, 0)
    want = numbers.select("id", F.sum("id").over(by).alias("s"), F.count("*").over(by).alias("n"))
    assert out.columns == [*numbers.columns, "s", "n", "nothing"]
    assert sorted(out.select("id", "s", "n").collect()) == sorted(want.collect())


def test_slices_follow_the_order_and_are_even(numbers):
    order = [("v", True), ("id", False)]
    sizes = numbers.select("*", slice_of(numbers, order, 6).alias("s")).groupBy("s").agg(
        F.count("*").alias("n"), F.max("v").alias("most"), F.min("v").alias("least")).orderBy("s").collect()
    assert len(sizes) == 6 and max(r["n"] for r in sizes) < 3 * 2000 / 6
    assert all(a["least"] >= b["most"] for a, b in zip(sizes, sizes[1:]) if a["least"] is not None and b["most"] is not None)


def test_rows_are_exchanged_once(numbers):
    out = running_totals(numbers.where("id >= 0"), [("v", False), ("id", False)], {"n": F.lit(1)}, slices=5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    wide = [x for x in re.findall(r"Exchange (\w+)\(([^\n]*)", plan) if "_slice" in x[1] and x[0] == "hashpartitioning" and "REPARTITION" in x[1]]
    assert len(wide) == 1 and "RDDScan" not in plan.replace("Scan ExistingRDD", "RDDScan") and "rangepartitioning" not in plan


def test_running_totals_of_few_rows(numbers):
    few = numbers.where("id < 3")
    assert sorted(r["n"] for r in running_totals(few, [("id", False)], {"n": F.lit(1)}, slices=7).collect()) == [1, 2, 3]
    assert running_totals(numbers.where("false"), [("id", False)], {"n": F.lit(1)}, slices=7).count() == 0
