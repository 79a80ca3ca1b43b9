"""Places, samples, evidence schemas."""

import json
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from concordat.operators import evidence as evd
from concordat.operators import places, sampling

ROOT = str(Path(__file__).resolve().parents[1])


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """A table of three files (one without rows) in small row groups, and a second table of the same length in two files."""
    folder = tmp_path_factory.mktemp("places")
    for name, parts in (("a", [range(0, 700), range(0), range(700, 1000)]), ("b", [range(0, 450), range(450, 1000)])):
        (folder / name).mkdir()
        for i, part in enumerate(parts):
            table = pa.table({f"{name}_key": pa.array([f"{name}{k}" for k in part], pa.string()), f"{name}_n": pa.array(list(part), pa.int64())})
            pq.write_table(table, folder / name / f"part-{i}.parquet", row_group_size=64)
    return folder


@pytest.mark.parametrize("split", ("128m", "2k"))
def test_places_do_not_depend_on_splits(spark, files, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = places.scan(spark, str(files / "a")).collect()
        assert {r["a_n"]: r[places.PLACE] for r in rows} == {i: i for i in range(1000)}
        part = places.scan(spark, str(files / "a"), ["a_n"]).where("a_n % 7 = 3").repartition(5)
        back = places.reattach(part, places.scan(spark, str(files / "a")), ["a_key"])
        assert {(r["a_n"], r["a_key"]) for r in back.collect()} == {(i, f"a{i}") for i in range(3, 1000, 7)}
        both = places.side_by_side(places.scan(spark, str(files / "a")), places.scan(spark, str(files / "b")).where("b_n <> 5")).collect()
        assert len(both) == 1000 and all(r["b_n"] == (None if r["a_n"] == 5 else r["a_n"]) for r in both)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_places_are_checked(spark, files):
    a = places.scan(spark, str(files / "a"))
    with pytest.raises(ValueError):
        places.side_by_side(a, a)
    far = a.withColumn(places.PLACE, F.col(places.PLACE) + 10_000)
    assert places.reattach(far.limit(3), a, ["a_key"]).where("a_key is null").count() == 3


RETRY = """
import sys
sys.path.insert(0, {root!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession
from concordat.operators import places
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").config(
    "spark.sql.files.maxPartitionBytes", "2k").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

def flaky(batches):
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("the first attempt is lost")
    yield from batches

a, b = (places.scan(spark, {folder!r} + "/" + n) for n in "ab")
lost = a.mapInArrow(flaky, a.schema)
rows = places.side_by_side(lost, b).collect()
assert sorted((r["a_n"], r["b_n"], r["_place"]) for r in rows) == [(i, i, i) for i in range(1000)]
print("same rows")
"""


def test_places_after_lost_tasks(files):
    done = subprocess.run([sys.executable, "-c", RETRY.format(root=ROOT, folder=str(files))], capture_output=True, text=True, timeout=300)
    assert "same rows" in done.stdout, done.stderr[-2000:]


# ---- Samples ---------------------------------------------------------------


@pytest.fixture(scope="module")
def numbers(spark):
    # One key holds most rows; values repeat.
    return spark.range(0, 20_000).select("id", F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("key"),
                                         F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("text"))


def test_sample_is_the_same_for_every_layout(spark, numbers):
    base = sorted(sampling.sample(numbers, 100, 7).collect())
    assert len(base) == len(set(base)) == 100
    for layout in (numbers.repartition(13), numbers.coalesce(1), numbers.orderBy(F.desc("id")), numbers.repartition(3, "key")):
        assert sorted(sampling.sample(layout, 100, 7).collect()) == base
    assert sorted(sampling.sample(numbers, 100, 8).collect()) != base
    assert sorted(sampling.sample(numbers, 100, 7).collect())[:1] == base[:1]


def test_sample_is_even(numbers):
    drawn = sampling.sample(numbers, 4000, 3)
    low = drawn.where("id < 10000").count()
    assert 1800 < low < 2200 and drawn.count() == 4000


def test_sample_for_each_key(numbers):
    want = Counter(r["key"] for r in numbers.select("key").collect())
    for layout in (numbers, numbers.repartition(9)):
        got = sampling.sample(layout, 30, 5, by=["key"]).collect()
        assert Counter(r["key"] for r in got) == {k: min(n, 30) for k, n in want.items()}
    ranks = numbers.withColumn("r", sampling.rank(5, numbers.columns)).where("key = 'hot'").orderBy("r").limit(30).select("id").collect()
    assert {r["id"] for r in got if r["key"] == "hot"} == {r["id"] for r in ranks}


def test_sketches_merge(numbers):
    ranked = numbers.withColumn(sampling.RANK, sampling.rank(1, numbers.columns))
    halves = sampling.sketch(ranked.where("id < 5000"), 50).unionAll(sampling.sketch(ranked.where("id >= 5000"), 50))
    assert sorted(sampling.merged(halves, 50).drop(sampling.RANK).collect()) == sorted(sampling.sample(numbers, 50, 1).collect())


def test_sample_edge_cases(spark, numbers, monkeypatch):
    few = numbers.limit(3)
    assert sorted(sampling.sample(few, 10, 1).collect()) == sorted(few.collect())
    assert sampling.sample(numbers.where("false"), 10, 1).count() == 0 and sampling.sample(numbers, 0, 1).count() == 0
    twice = few.unionAll(few)
    assert sampling.sample(twice, 6, 1).count() == 6
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("", 3), ("x", 4)], "key string, n int")
    assert {r["key"] for r in sampling.sample(nulls, 1, 1, by=["key"]).collect()} == {None, "", "x"}


def test_many_keys_are_sent_on(numbers, monkeypatch):
    monkeypatch.setattr(sampling, "HELD", 100)
    every = numbers.withColumn("key", F.col("id") % 5000).coalesce(2)
    got = sampling.sample(every, 2, 9, by=["key"])
    assert got.count() == 10_000 and got.groupBy("key").count().where("count <> 2").count() == 0


# ---- Evidence --------------------------------------------------------------

PLAIN = "species array<string>, temp_range_i int"
NESTED = "name string, place struct<site:string>, surveys array<struct<year:int>>, by_key map<string,struct<n:int>>"


def test_extended_schema_round_trip():
    for ddl in (PLAIN, NESTED):
        schema = StructType.fromDDL(ddl)
        for deep in (False, True):
            extended = evd.with_evidence(schema, deep=deep)
            assert extended["evidence"].dataType.elementType == evd.EVIDENCE
            assert evd.with_evidence(extended, deep=deep) == extended and evd.without_evidence(extended) == schema
            assert StructType.fromJson(json.loads(extended.json())) == extended
    deep = evd.with_evidence(StructType.fromDDL(NESTED), deep=True)
    assert all("evidence" in t.names for t in (deep["place"].dataType, deep["surveys"].dataType.elementType, deep["by_key"].dataType.valueType))
    with pytest.raises(ValueError):
        evd.with_evidence(StructType.fromDDL("evidence string"))


def test_confidence_is_between_0_and_5(spark):
    piece = lambda c: {"field_name": "species", "confidence": c, "quote": "é"}
    rows = [(i, json.dumps({"species": ["a"], "evidence": [piece(c)]})) for i, c in enumerate((-1, 0, 5, 6, None))]
    rows += [(10, None), (11, "{"), (12, '{"species": ["b"]}'), (13, '{"species": [], "evidence": []}')]
    parsed = evd.parse(spark.createDataFrame(rows, "id int, reply string"), "reply", StructType.fromDDL(PLAIN))
    good, bad = evd.quarantine(parsed, "id")
    assert {r["id"] for r in good.collect()} == {1, 2, 4, 10, 12, 13}
    assert {(r["row_id"], r["field"], r["raw_value"], r["suggested_fix"]) for r in bad.collect()} == {
        (0, "evidence.0.confidence", "-1", "0"), (3, "evidence.0.confidence", "6", "5"), (11, "output", "{", "")}
    kept = {r["id"]: r["output"] for r in good.collect()}
    assert kept[1]["evidence"][0]["quote"] == "é" and kept[12]["evidence"] is None and kept[10] is None


def test_evidence_at_every_depth(spark):
    bad = [{"field_name": "year", "confidence": 9}, {"confidence": 1}]
    reply = {"name": "x", "place": {"site": "s", "evidence": bad[:1]}, "surveys": [{"year": 1}, {"year": 2, "evidence": bad}],
             "by_key": {"k": {"n": 1, "evidence": bad[1:]}}, "evidence": [{"field_name": "colour", "confidence": 2}]}
    schema = StructType.fromDDL(NESTED)
    parsed = evd.parse(spark.createDataFrame([(1, json.dumps(reply))], "id int, reply string"), "reply", schema, deep=True)
    fields = lambda df: sorted(r["field"] for r in evd.quarantine(df, "id")[1].collect())
    deep = ["by_key.k.evidence.0.field_name", "place.evidence.0.confidence", "surveys.1.evidence.0.confidence", "surveys.1.evidence.1.field_name"]
    assert fields(parsed) == deep
    extended = evd.with_evidence(schema, deep=True)
    told = parsed.withColumn("errors", evd.evidence_errors(F.col("output"), extended, known_fields=True))
    assert fields(told) == sorted([*deep, "evidence.0.field_name", "place.evidence.0.field_name"])
    assert "MapInArrow" not in parsed._jdf.queryExecution().executedPlan().toString()
