"""What keeps queries within their limits on large tables: plans without oversized broadcasts, parts, state and rows."""

import io
import json
import random
import time
from datetime import datetime, timedelta

import numpy as np
import pyarrow.fs as fs
import pytest
from pyspark.sql import functions as F

from concordat.functions import sections as sec
from concordat.functions.text import ascii_key, clean_markup
from concordat.operators import chunking as ch
from concordat.operators import evaluate as ev
from concordat.plans import texts
from concordat.sources import json_arrays, readers, run_sink
from concordat.streaming import status_chain as sc


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_events_are_not_broadcast(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"), F.concat(
        F.lit('{"k": '), "id", F.lit("}")).alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    found = texts.jsonl_props_extract(spark, str(tmp_path))
    assert "Broadcast" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [(i, i, "view", f"10.1/{i % 7}") for i in range(50)]


def test_parts_of_a_run_are_compressed(spark, tmp_path):
    writer = run_sink._Writer({"path": f"{tmp_path}/run.json", "header": "{}", "attempt": "a"})
    system, name = fs.LocalFileSystem(), f"{writer.staged}/records-0-x"
    system.create_dir(writer.staged)
    with system.open_output_stream(name, compression=run_sink.CODEC) as out:
        out.write(b",\n".join(b'{"n": 1}' for _ in range(5000)))
    writer.commit([run_sink.Part([("records", 0, name, 5000)])])
    assert len(json.load(open(f"{tmp_path}/run.json"))["records"]) == 5000


@pytest.mark.parametrize("range_bytes", (97, 4000, 1 << 20))
def test_evaluation_results_read_by_ranges(spark, tmp_path, range_bytes):
    made = spark.range(30).select(F.col("id").alias("gt_record_id"), F.lit("a [\" field_results\": [").alias("title"))
    sides = spark.range(30).select(F.col("id").cast("string").alias("record_id"), (F.col("id") % 4).cast("int").alias("temp_range_i"))
    run_sink.write_run_artifact(made, f"{tmp_path}/a.json", {"name": "a"}, aligned=ev.align(sides, sides.where("temp_range_i > 0"), "record_id"))
    run_sink.write_run_artifact(made, f"{tmp_path}/b.json", {"name": "b"})
    want = readers.evaluation_results(readers.run_artifacts(spark, str(tmp_path)))
    assert want.count() == 360
    assert sorted(map(str, readers.split_evaluation_results(spark, str(tmp_path), range_bytes=range_bytes).collect())) == sorted(map(str, want.collect()))
    assert json_arrays.elements(spark, str(tmp_path), member="records", range_bytes=range_bytes).count() == 60


@pytest.mark.parametrize("retries", (0, 2))
def test_statuses_of_a_batch_need_no_state(spark, retries):
    draw = random.Random(retries)
    rows = [(f"w{draw.randrange(60)}", draw.choice([*sc.STEPS, "SHIPPED", None]), draw.randrange(6), draw.choice([True, False, False, None]),
             None, datetime(2026, 1, 1) + timedelta(minutes=draw.randrange(900))) for _ in range(900)]
    rows = [(*r[:4], f"{r[1]} {r[2]}", r[5]) for r in rows]
    found = sc.statuses(spark.createDataFrame(rows, sc.EVENTS), retries)
    assert "TransformWithState" not in plan(found)
    want = {}
    for work in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == work]
        failed = {}
        for step in sc.STEPS:
            tries = {(r[1], r[2]): r[4] for r in own if r[1] == step and not r[3]}
            failed |= dict(sorted(tries.items(), key=lambda x: -x[0][1])[:retries + 1])
        want[work] = (*sc.status_of({r[1] for r in own if r[3]}, failed, retries), max(r[5] for r in own))
    assert {r["work_id"]: tuple(r)[1:] for r in found.collect()} == want


def test_a_chunk_does_not_hold_its_section(spark):
    text = " ".join(f"Sentence number {i} ends here." for i in range(400))
    out = ch.with_chunks(spark.createDataFrame([("W1", None, [("s1", "Methods", 1, "", text, None, None)])],
                                               f"work_id string, abstract string, sections array<{ch.SECTION}>"), F.col("sections"), texts.CHUNKS)
    assert "text" not in out.schema["chunks"].dataType.elementType["section"].dataType.names
    row = out.select(F.size("chunks").alias("n"), F.length(F.to_json("chunks")).alias("size")).first()
    assert row["n"] > 20 and row["size"] < 5 * len(text)


def test_keys_of_plain_texts_are_not_cleaned(spark):
    rows = [("A  b\x1c\tC-1",), ("a<b>c</b> d",), ("a &amp;lt; b",), ("é x y",), (" \n",), ("",), (None,), ("a < b",), ("x & y",)]
    df = spark.createDataFrame(rows, "t string")
    with_cleaning = ascii_key(clean_markup("t"), cleaned=True)
    assert all(a == b for a, b in df.select(ascii_key("t"), with_cleaning).collect())
    plain = df.where("t = 'A  b\x1c\tC-1'").select(ascii_key("t")).first()
    assert plain[0] == "a b c 1"


def test_a_sentence_of_many_pieces_is_split_once(spark):
    """Time must not grow with the square of a sentence's pieces."""
    text = "word " * 60_000
    out = ch.chunk_text(spark.createDataFrame([(text,)], "text string"), "text", texts.CHUNKS).agg(F.count(F.lit(1)), F.sum("token_count"))
    began = time.time()
    assert tuple(out.first()) == (750, 60_000)
    assert time.time() - began < 40


def test_ranges_are_read_once_and_little_behind_them(tmp_path):
    """Of short elements, ranges of 64 KB must not read on a megabyte each."""
    rows = [{"record_id": str(i), "field": "species", "t": "a\\ \"é"} for i in range(20_000)]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(rows, indent=1, ensure_ascii=False), encoding="utf-8")
    raw = np.frombuffer(path.read_bytes(), np.uint8)
    text, depth = json_arrays.levels(raw, False, False, 0)
    seen = []

    class Counted(io.BytesIO):
        def read(self, size=-1):
            seen.append(size)
            return super().read(size)

    file, found, step = Counted(raw.tobytes()), [], 1 << 16
    for start in range(0, len(raw), step):
        state = {"path": str(path), "length": len(raw), "start": start, "inside": bool(start and text[start - 1]),
                 "depth": int(depth[start - 1]) if start else 0, "from": -1}
        at, values = json_arrays._elements(file, state, step, 1)
        assert (np.diff(at.to_numpy()) > 0).all()
        found += values.to_pylist()
    assert [json.loads(v) for v in found] == rows
    assert sum(seen) < 1.2 * len(raw)


@pytest.mark.parametrize("range_bytes", (83, 1 << 16))
def test_the_model_of_a_run_is_read_by_ranges(spark, tmp_path, range_bytes):
    records = [{"gt_record_id": i, "title": '"model": "x"'} for i in range(12)]
    bodies = {"before": {"model": 'g "5", {', "records": records}, "behind": {"records": records, "meta": {"model": "no"}, "model": "m"},
              "number": {"model": 5, "records": records}, "none": {"records": records, "model": None}, "missing": {"records": records},
              "object": {"model": {"a": [1, "}"]}, "records": records}}
    for name, body in bodies.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    split = readers.split_run_records(spark, str(tmp_path), range_bytes=range_bytes)
    assert "Scan json" not in plan(split)  # which one task does for a file
    whole = readers.run_records(readers.run_artifacts(spark, str(tmp_path)))
    assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect())) and split.count() == 72


def test_results_are_ordered_before_they_are_one_row_a_field(spark, tmp_path, monkeypatch):
    """What is sampled and shuffled for the order of a run's results is a row a record."""
    sides = spark.range(30).select(F.col("id").cast("string").alias("record_id"), (F.col("id") % 4).cast("int").alias("temp_range_i"))
    dealt = []
    kind = type(sides)
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, *a, f=kind.repartitionByRange: dealt.append(self.columns) or f(self, *a))
    made = sides.select(F.col("record_id").cast("long").alias("gt_record_id"), F.lit("t").alias("title"))
    run_sink.write_run_artifact(made, f"{tmp_path}/a.json", {"name": "a"}, aligned=ev.align(sides, sides, "record_id"))
    assert dealt and not any("value" in columns for columns in dealt)
    body = json.load(open(f"{tmp_path}/a.json"))
    assert [r["gt_record_id"] for r in body["records"]] == list(range(30))
    order = [(r["record_id"], r["field"]) for r in body["evaluation"]["field_results"]]
    assert order == sorted(order) and len(set(order)) == 360 and list(body["evaluation"]["field_metrics"]) == sorted(ev.DEFAULT_STRATEGIES)


def test_described_chunks_are_cut_once(spark, tmp_path):
    """What is described several times over are rows already cut; before, each pass over them cut all texts again."""
    long = " ".join(f"Sentence number {i} ends here." for i in range(60))
    rows = [(1, "en", long), (2, "en", "short"), (3, "fr", long), (4, "fr", " \n"), (5, None, "one. two."), (6, "de", None)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = texts.chunk_stats(spark, str(tmp_path))
    assert "Python" not in plan(found) and "Arrow" not in plan(found)
    assert {r["lang"]: (r["count"], r["min"], r["max"]) for r in found.collect()} == {"en": (6, 1, 80), "fr": (5, 60, 80), None: (1, 2, 2)}


def test_sentences_are_the_same_in_both_engines(spark):
    draw = random.Random(4)
    parts = ["a", "et al.", "e.g. ", "Fig.", "Dr. B", ".", "!", "? ", " ", "\n", "\u00a0", "\x1c", "\u2003", "@", "é", "\U0001f600", "..", "x"]
    made = ["", " ", ".", " . ", "a. ", *("".join(draw.choice(parts) for _ in range(draw.randint(1, 25))) for _ in range(400))]
    df = spark.createDataFrame([(t,) for t in made], "t string")
    for literal in (False, True):
        found = df.select("t", sec.sentences("t", literal_at_sign=literal).alias("s")).collect()
        assert all(sec.sentences_of(r["t"], literal_at_sign=literal) == r["s"] for r in found)


def test_sections_that_are_blank_or_missing(spark):
    rows = [("W1", [("s1", "a b c"), None, ("s2", None), ("s3", "\u00a0 "), ("s4", "One two. Three four five. Six " + "w " * 9)]), ("W2", None), ("W3", [])]
    df = spark.createDataFrame(rows, "work_id string, sections array<struct<section_id:string,text:string>>")
    config = ch.ChunkConfig(target_tokens=3, max_tokens=4, overlap_tokens=2)
    found = ch.with_chunks(df, F.col("sections"), config).orderBy("work_id").collect()
    assert [(c["section"]["section_id"], c["chunk_index_in_section"], c["text"], c["char_start"], c["char_end"]) for c in found[0]["chunks"]] == [
        ("s1", 0, "a b c", 0, 5), ("s4", 0, "One two.", 1, 9), ("s4", 1, "One two. Three four five.", 1, 26),
        ("s4", 2, "Six w w w ", 26, 36), ("s4", 3, "w w w w ", 36, 44), ("s4", 4, "w w", 44, 47)]
    assert found[0]["_counts"] == [3, 2, 5, 4, 4, 2] and not found[1]["chunks"] and found[2]["chunks"] == []
