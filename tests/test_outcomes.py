"""Map outputs in the extraction CSV, and outcomes split by one job."""

import json
import os

from pyspark.sql import functions as F

from concordat.operators import grounding, runs
from concordat.sources import sinks, staged


def test_map_outputs_are_widened_in_first_seen_order(spark, tmp_path):
    rows = [(3, "success", {"b": "3", "status": "no"}), (1, "success", {"z": '["x"]', "a": " 1 "}), (2, "error", None), (4, "success", {}), (5, "success", {"a": "é\"q\"", "c": None})]
    texts = [(i, s, o if o is None else json.dumps(o)) for i, s, o in rows]  # a map from Python would lose its order
    df = spark.createDataFrame(texts, "gt_record_id int, status string, output string").withColumn(
        "output", F.from_json("output", "map<string,string>")).repartition(4)
    wide = runs.extraction_table_of_maps(df, "gt_record_id")
    assert wide.columns == [*runs.CSV_BASE, "z", "a", "b", "c"]
    got = {r["gt_record_id"]: (r["status"], r["z"], r["a"], r["b"], r["c"]) for r in wide.collect()}
    assert got == {"1": ("success", '["x"]', " 1 ", "", ""), "2": ("error", "", "", "", ""), "3": ("success", "", "", "3", ""),
                   "4": ("success", "", "", "", ""), "5": ("success", "", 'é"q"', "", "")}
    sinks.write_extraction_csv(df, str(tmp_path / "x"), order="gt_record_id")
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "x"))
    assert back.columns == wide.columns and {r["a"] for r in back.collect()} == {" 1 ", 'é"q"', None}
    assert runs.extraction_table_of_maps(df.where("false"), "gt_record_id").columns == list(runs.CSV_BASE)


def test_work_runs_once_and_both_lists_are_complete(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    folder = str(log)

    def work(batches):
        import uuid

        for batch in batches:
            for i in batch.column("id").to_pylist():
                open(os.path.join(folder, f"{i}-{uuid.uuid4().hex}"), "w").close()
            yield batch

    df = spark.range(60).repartition(3).mapInArrow(work, "id long").withColumn(
        "ok", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 3 > 0))
    split = runs.split_outcomes(df, F.col("ok"), str(tmp_path / "out"))
    good = {i for i in range(60) if i % 7 and i % 3}
    assert (split.n_succeeded, split.n_failed) == (len(good), 60 - len(good))
    assert {r["id"] for r in split.succeeded.collect()} == good
    assert {r["id"] for r in split.failed.collect()} == set(range(60)) - good
    assert len(os.listdir(folder)) == 60
    none = runs.split_outcomes(df.where("id < 0"), F.col("ok"), str(tmp_path / "none"))
    assert (none.n_succeeded, none.n_failed, none.succeeded.count()) == (0, 0, 0)


def test_lookup_keeps_requests_without_a_doi(spark):
    requests = spark.createDataFrame([(i, None if i % 2 else f"10.1/{i}") for i in range(20)], "id int, doi string")
    catalogue = spark.createDataFrame([("10.1/4", "four")], "doi string, name string")
    found = staged.lookup_by_doi(requests, catalogue)
    assert "rand(" not in found._jdf.queryExecution().toString()
    assert {r["id"]: r["found_name"] for r in found.collect()} == {i: "four" if i == 4 else None for i in range(20)}


def test_comparison_table_is_sorted(spark):
    rows = [(2, "b", "match", "x"), (1, "b", "match", "y"), (1, "a", "pred_only", None), (1, "a", "gt_only", "z"), (1, "a", "pred_only", "k"), (10, "a", "match", "q")]
    table = spark.createDataFrame(rows, "id int, field string, bucket string, target_value string").repartition(3)
    got = [tuple(r) for r in grounding.in_order(table, "id").collect()]
    assert got == [(1, "a", "gt_only", "z", "1 · a"), (1, "a", "pred_only", "k", "1 · a"), (1, "a", "pred_only", None, "1 · a"), (1, "b", "match", "y", "1 · b"),
                   (2, "b", "match", "x", "2 · b"), (10, "a", "match", "q", "10 · a")]


def test_reasoning_settings(spark):
    cases = [("low", None, {"effort": "low"}, "low"), (" ", None, None, None), (None, " medium ", {"effort": "medium"}, "medium"),
             ('{"effort": " low ", "n": 1}', None, {"effort": "low", "n": "1"}, "low"), ('{"effort": "low"}', "high", {"effort": "low"}, "high"),
             ('{"effort": " "}', None, {"effort": " "}, None), ("{}", "high", {}, "high"), (None, None, None, None), ("", "high", None, "high")]
    df = spark.createDataFrame([(i, r, e) for i, (r, e, *_) in enumerate(cases)], "i int, r string, e string")
    got = {x["i"]: x["s"] for x in df.select("i", runs.reasoning_settings(F.col("r"), F.col("e")).alias("s")).collect()}
    for i, (_, _, want, effort) in enumerate(cases):
        assert (got[i]["reasoning"], got[i]["effort"]) == (want, effort), cases[i]
