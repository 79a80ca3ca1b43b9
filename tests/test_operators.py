"""Operators end to end on small frames: chunking, tables, sources, streams, relevance, taxonomy."""

import json
import random

import pytest
from pyspark.sql import functions as F

from concordat.functions.sections import CodecTokens
from concordat.operators import chunking as ch
from concordat.operators import embedding_cache as ec
from concordat.operators import grounding as gr
from concordat.operators import manifest as mf
from concordat.operators import normalize as nz
from concordat.operators import registry as rg
from concordat.operators import relevance as rel
from concordat.operators import runs
from concordat.operators import sections as so
from concordat.operators import taxonomy as tx
from concordat.operators import vectors as vx
from concordat.operators.evaluate import EvalConfig, FieldStrategy, align, field_metrics
from concordat.operators.running import running_totals
from concordat.sources import readers, sinks, tei
from concordat.streaming import registry_sync


def expected_chunks(text, limit, overlap):
    """Independent statement of the packing rule, on plain words."""
    import re

    words = lambda s: re.findall(r"\s*\S+\s*", s)
    if not text.strip():
        return []
    if len(words(text)) <= limit:
        return [(text, 0, len(text))]
    out, cur, pos = [], [], 0
    for s in [x.strip() for x in re.split(r"(?<=[.!?])\s+", text) if x.strip()]:
        n = len(words(s))
        if n > limit:
            if cur:
                body = " ".join(cur)
                out.append((body, pos - len(body), pos))
                cur = []
            w = words(s)
            for k in range(0, n, limit):
                piece = "".join(w[k:k + limit])
                out.append((piece, pos, pos + len(piece)))
                pos += len(piece)
            cur_tokens = 0
            continue
        if sum(len(words(x)) for x in cur) + n > limit:
            body = " ".join(cur)
            out.append((body, pos - len(body), pos))
            tail = []
            for x in reversed(cur):
                if sum(len(words(y)) for y in tail) + len(words(x)) > overlap:
                    break
                tail.insert(0, x)
            cur = tail
        cur.append(s)
        pos += len(s) + 1
    if cur:
        body = " ".join(cur)
        out.append((body, max(0, pos - len(body)), pos))
    return out


def test_chunker_against_mirror(spark):
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) + rng.choice(["", "", "", ".", "!"])
                      for _ in range(rng.choice([3, 30, 90, 200]))) for _ in range(40)] + ["  ", "", "one. two."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    config = ch.ChunkConfig(target_tokens=12, max_tokens=15, overlap_tokens=5)
    rows = ch.chunk_text(df, "text", config).orderBy("i", "chunk_index").collect()
    got = {i: [(r.text, r.char_start, r.char_end) for r in rows if r.i == i] for i in range(len(texts))}
    for i, t in enumerate(texts):
        assert got[i] == expected_chunks(t, 15, 5), t


def test_chunker_with_codec(spark):
    class LetterCodec:  # local, so that it travels with the function
        def encode(self, text):
            return [ord(c) for c in text]

        def decode(self, ids):
            return "".join(map(chr, ids))

    df = spark.createDataFrame([(1, "abcdefgh. ij. kl."), (2, "ab.")], "i int, text string")
    config = ch.ChunkConfig(target_tokens=5, max_tokens=6, overlap_tokens=3)
    rows = ch.chunk_text(df, "text", config, tokenizer=CodecTokens(LetterCodec)).orderBy("i", "chunk_index").collect()
    assert [(r.i, r.text, r.token_count) for r in rows] == [(1, "abcdef", 6), (1, "gh.", 3), (1, "ij. kl.", 7), (2, "ab.", 3)]
    with pytest.raises(ValueError):
        ch.ChunkConfig(target_tokens=10, max_tokens=5)


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>A <hi>T</hi></title></titleStmt></fileDesc>
<profileDesc><abstract><p>One.</p><p> </p><p>Two.</p></abstract><textClass><keywords><term> k1 </term><term/></keywords></textClass>
<langUsage><language ident="fr"/></langUsage></profileDesc></teiHeader><text><body>
<div coords="3,1,1;2,1,1"><head>Methods</head><p>m <ref>1</ref></p><div><head>Site</head><p>s</p></div></div><div><p>x</p></div></body></text></TEI>"""


def test_tei_documents(spark, tmp_path):
    (tmp_path / "W1.tei.xml").write_text(TEI)
    (tmp_path / "W2.tei.xml").write_text("<broken")
    docs = {d.work_id: d for d in tei.scan(spark, str(tmp_path)).collect()}
    d = docs["W1"]
    assert (d.title, d.abstract, d.language, d.keywords) == ("A T", "One.\n\nTwo.", "fr", ["k1"])
    assert [(s.section_id, s.path, s.level, s.text, s.page_start, s.page_end) for s in d.sections] == [
        ("W1_sec_1", "Methods", 1, "m 1", 2, 3), ("W1_sec_2", "Methods > Site", 2, "s", None, None),
        ("W1_sec_3", "Untitled", 1, "x", None, None)]
    assert not docs["W2"].parse_ok
    prompt = so.sections_mode(tei.scan(spark, str(tmp_path)).filter("work_id = 'W1'")).first().prompt_text
    assert prompt == "## Abstract\nOne.\n\nTwo.\n\n## Methods\nm 1\n\n## Site\ns\n\n"
    chunks = ch.chunk_documents(tei.scan(spark, str(tmp_path)).filter("parse_ok")).orderBy("chunk_id").collect()
    assert [(c.chunk_id, c.section_type, c.is_abstract) for c in chunks] == [
        ("W1_chunk_1", "ABSTRACT", True), ("W1_chunk_2", "METHODS", False), ("W1_chunk_3", "OTHER", False), ("W1_chunk_4", "OTHER", False)]


def test_registry_cascade_and_stream(spark, tmp_path):
    registry = rg.Registry(spark, str(tmp_path / "reg"), buckets=4)
    registry.init()
    registry.init()
    landing = tmp_path / "in"
    landing.mkdir()
    event = {"work_id": "w1", "pdf_sha256": "s", "source_path": "p", "status": "PENDING", "updated_at": "2026-01-01T00:00:00Z"}
    later = {**event, "status": "PARSED", "updated_at": "2026-01-02T00:00:00Z"}
    (landing / "a.json").write_text("\n".join(json.dumps(e) for e in (later, event, {**event, "work_id": "w2"})))
    for _ in range(2):  # the second run finds nothing new
        q = registry_sync.sync_registry(registry_sync.read_updates(spark, str(landing)), registry, str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert {(r.work_id, r.status) for r in registry.documents().collect()} == {("w1", "PARSED"), ("w2", "PENDING")}
    assert registry.by_status("PENDING").count() == 1 and registry.document("w1").count() == 1
    chunk = [("w1_chunk_1", "w1", "s1", 0, False), ("w2_chunk_1", "w2", "s1", 0, False)]
    schema = "chunk_id string, work_id string, section_id string, chunk_index_in_section int, vector_indexed boolean"
    add = lambda rows: registry.upsert_chunks(spark.createDataFrame(rows, schema).withColumn("updated_at", F.current_timestamp()))
    add(chunk)
    add([("w1_chunk_1", "zz", "zz", 9, True)])
    first = registry.chunks_of("w1").first()
    assert (first.section_id, first.vector_indexed) == ("s1", True)
    assert registry.delete_documents(spark.createDataFrame([("w1",)], "work_id string")) == 1
    assert [r.work_id for r in registry.documents().collect()] == ["w2"]
    assert [r.work_id for r in registry.chunks().collect()] == ["w2"]


def test_vector_table(spark, tmp_path):
    store = vx.VectorTable(spark, str(tmp_path / "v"), 2, buckets=2)
    store.init()
    payload = spark.createDataFrame([("c1", "w1", "t"), ("c2", "w2", "u")], "chunk_id string, work_id string, text string")
    vectors = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.0, 2.0])], "chunk_id string, embedding array<float>")
    store.upsert(payload, vectors)
    store.upsert(payload.limit(2), vectors)
    assert store.rows().count() == 2
    hits = vx.search(store.rows(), [0.0, 1.0], limit=1).collect()
    assert hits[0].chunk_id == "c2" and hits[0].score == pytest.approx(1.0)
    assert store.delete_work("w2") == 1 and store.rows().count() == 1
    with pytest.raises(Exception, match="unexpected length"):
        store.upsert(payload, spark.createDataFrame([("c1", [1.0])], "chunk_id string, embedding array<float>"))
    assert vx.similarity and spark.range(1).select(vx.point_id(F.lit("W1_chunk_1")).alias("r")).first().r == int.from_bytes(
        __import__("hashlib").md5(b"W1_chunk_1").digest()[:8], "big")


def test_embedding_cache(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "chunk_id string, text string")
    cache = spark.createDataFrame([("a", "x"), ("b", "old")], "chunk_id string, t string").select(
        "chunk_id", ec.text_hash("t").alias("text_hash"), F.lit("m").alias("model"), F.lit(1).alias("dimensions"),
        F.array(F.lit(1.0).cast("float")).alias("embedding"))
    found = ec.cache_lookup(chunks, cache, model="m", dimensions=None)
    assert {r.chunk_id: r.hit for r in found.collect()} == {"a": True, "b": False, "c": False}
    fresh = ec.embed_missing(found, lambda texts: [[float(len(t))] for t in texts], model="m")
    assert sorted(r.chunk_id for r in ec.merged_cache(cache, fresh).collect()) == ["a", "b", "c"]
    ec.merged_cache(cache, fresh).write.json(str(tmp_path / "cache"))
    assert readers.embedding_cache(spark, str(tmp_path / "cache")).count() == 3


def test_running_totals_over_a_hot_key(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2500, 0).otherwise(F.col("id")).alias("k"), (F.col("id") * 7919 % 1000).alias("v"))
    out = running_totals(df, [("v", True), ("id", False)], {"s": F.col("v"), "n": F.lit(1)}, keys=["k"], slices=7)
    hot = sorted((r for r in out.collect() if r.k == 0), key=lambda r: (-r.v, r.id))
    total = 0
    for i, r in enumerate(hot, 1):
        total += r.v
        assert (r.n, r.s) == (i, total)


def test_relevance_tie_patterns(spark):
    # Published tie-break patterns (data type, temporal, spatial, outcome).
    patterns = ["HLMM", "HLXL", "HMLM", "HMXL", "HXLL", "HXML", "LHML", "LHXL", "LMHL", "LMXL", "LXHL", "MLHM", "MLXL", "MXHM",
                "MXLL", "XLHX", "XMHX", "HHLH", "LXXX"]
    df = spark.createDataFrame([tuple(p) for p in patterns], "a string, b string, c string, want string")
    bad = df.filter(rel.majority_vote(F.col("a"), F.col("b"), F.col("c")) != F.col("want"))
    assert bad.count() == 0
    row = spark.createDataFrame([("genetic analysis", None, 2000, 2011, 6000.0, True, None)],
                                "raw_data_type string, data_type_primary string, temp_range_i int, temp_range_f int, spatial_range_km2 double, multispecies boolean, bias_north_south int")
    r = rel.classify(row).first()
    assert (r.mc_data_type, r.mc_temporal, r.mc_spatial, r.mc_relevance, r.pred_relevance) == ("L", "H", "M", "L", "M")


def test_taxonomy_evaluation(spark):
    truth = spark.createDataFrame([("1", ["30 bird species"])], "rid string, species array<string>")
    pred = spark.createDataFrame([("1", [f"Birdus species{i}" for i in range(30)])], "rid string, species array<string>")
    names = spark.createDataFrame([(f"Birdus species{i}", 1000 + i) for i in range(30)], "name string, usage_key bigint")
    backbone = names.select("name", "usage_key", F.col("name").alias("scientific_name"), F.col("name").alias("canonical_name"), F.lit("SPECIES").alias("rank"),
                            F.lit(100).alias("confidence"), F.lit("EXACT").alias("match_type"), *[F.lit(v).alias(k) for k, v in (
                                ("kingdom", "Animalia"), ("phylum", "Chordata"), ("class", "AVES"), ("order", "P"), ("family", "C"), ("genus", "Co"))])
    fields = ["species_richness_counts", "taxon_broad_group_labels"]
    m = {r.field: r for r in field_metrics(tx.evaluate_taxonomy(truth, pred, "rid", backbone, fields=fields)).collect()}
    assert all((m[f].tp, m[f].fp, m[f].fn) == (1, 0, 0) for f in fields)


def test_names_are_stripped_once_for_each_use(spark):
    lists = spark.createDataFrame([("1", ["3 mice, Rana temporaria and rana Temporaria", None, "Rana temporaria"]), ("2", []), ("3", None)],
                                  "rid string, species array<string>")
    uses = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count(r"\band\b")
    left = lists.select("rid", tx.taxa.stripped_names("species").alias("names"))
    assert dict(left.collect()) == {"1": ["Rana temporaria"], "2": None, "3": None} and uses(left) == 1
    names = spark.createDataFrame([("Rana temporaria",)], "name string").select("name", F.lit(7).alias("usage_key"), *[F.lit(None).cast("string").alias(
        c) for c in tx.BACKBONE_COLUMNS[2:5]], F.lit(100).alias("confidence"), F.lit("EXACT").alias("match_type"), *[F.lit(None).cast("string").alias(
            c) for c in tx.BACKBONE_COLUMNS[7:]])
    rich = tx.enrich(lists, "rid", names).select("rid", "gbif_keys", "gbif_key_stripped_richness", "species_stripped_richness")
    assert sorted(map(tuple, rich.collect())) == [("1", [7], [7], ["Rana temporaria"]), ("2", None, None, None), ("3", None, None, None)]
    assert uses(rich) == 3  # the column, the distinct names, and the way back to their records


def test_manifest_round_trip_and_errors(spark, tmp_path):
    gt = spark.createDataFrame([(1, "dryad", "https://doi.org/10.5061/DRYAD.x", "10.1371/J", 1.0, "t,1"), (2, " ", None, "none", None, 'q"')],
                               "id int, source string, source_url string, cited_article_doi string, is_oa double, title string")
    pdfs = spark.createDataFrame([(1, "a\\b.pdf", True), (2, "", None)], "record_id int, downloaded_pdf_path string, is_oa boolean")
    built = mf.build(gt, pdfs)
    sinks.write_manifest(built, str(tmp_path / "m"))
    rows = {r.gt_record_id: r for r in readers.manifest(spark, str(tmp_path / "m")).collect()}
    assert (rows[1].source_doi, rows[1].article_doi, rows[1].pdf_local_path, rows[1].is_oa) == ("10.5061/dryad.x", "10.1371/j", "data/pdfs/a/b.pdf", True)
    assert rows[2].source is None and rows[2].title == 'q"' and rows[2].pdf_local_path is None
    assert mf.pdf_coverage(built).first().no_pdf_path == 1
    with pytest.raises(Exception, match="id is not unique"):
        mf.build(gt.union(gt), pdfs).collect()
    nine = spark.createDataFrame([(9,), (1,)], "id int")
    with pytest.raises(Exception, match="no record has the id 9"):
        mf.build(gt, pdfs, subset=nine).collect()
    assert [r.id for r in mf.unknown_ids(gt, nine, "id").collect()] == [9]
    assert [r.gt_record_id for r in mf.build(gt, pdfs, subset=nine.filter("id = 1")).collect()] == [1]
    with pytest.raises(Exception, match="no PDF path for record 2"):
        mf.build(gt, pdfs, allow_missing_pdf=False).collect()
    # Two downloads of a record: the last one in order counts; without an order they are an error.
    twice = pdfs.withColumn("ord", F.lit(1)).unionByName(spark.createDataFrame(
        [(1, "later.pdf", False, 2)], "record_id int, downloaded_pdf_path string, is_oa boolean, ord int"))
    assert {r.gt_record_id: r.pdf_local_path for r in mf.build(gt, twice, order="ord").collect()} == {1: "data/pdfs/later.pdf", 2: None}
    with pytest.raises(Exception, match="record_id is not unique"):
        mf.build(gt, twice).collect()
    with pytest.raises(KeyError):
        mf.replace_pdf_path(built, 99, "x")
    assert mf.replace_pdf_path(built, 2, "p").filter("gt_record_id = 2").first().pdf_local_path == "p"


def test_validation_split(spark):
    sheet = spark.createDataFrame([(1, "abundance", "5"), (2, "nonsense thing", "-1"), (3, "N/A", "x")], "id int, data_type string, spatial_range_km2 string")
    report = nz.validate(sheet, "id", coerce_cells=True)
    assert sorted(r.id for r in report.valid.collect()) == [1, 3]
    errors = {(e.row_id, e.field): e for e in report.errors.collect()}
    assert set(errors) == {(2, "data_type.0"), (2, "spatial_range_km2")}
    assert errors[2, "data_type.0"].message.startswith("Input should be 'abundance'")
    summary = {(r.section, r.name): r.n for r in nz.validation_summary(report).collect()}
    assert summary["rows", "valid"] == 2 and summary["rows", "invalid"] == 1


def test_run_isolation_and_artifacts(spark, tmp_path):
    def extractor(text):
        if "bad" in text:
            raise ValueError("no")
        return {"species": [text]}

    records = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, " ")], "gt_record_id bigint, abstract string")
    out = {r.gt_record_id: r for r in runs.extract_with(records, "abstract", extractor, "species array<string>").collect()}
    assert out[1].output.species == ["ok"] and out[2].error == "ValueError: no" and 3 not in out
    artifact = {"name": "r", "mode": "abstract", "model": "gpt-5-mini", "reasoning": '{"effort": " low "}', "records": [
        {"gt_record_id": 1, "record_id": "d", "mode": "abstract", "status": "success", "output": {"species": ["a"]}},
        {"gt_record_id": 2, "record_id": "e", "mode": "abstract", "status": "error"}],
        "evaluation": {"field_metrics": {"species": {"tp": 1, "f1": 1.0}}, "field_results": [{"record_id": "1", "field": "species", "match": True, "tp": 1}]}}
    (tmp_path / "20260101_000000_r.json").write_text(json.dumps(artifact, indent=2))
    loaded = readers.run_artifacts(spark, str(tmp_path))
    assert loaded.first().reasoning_effort == "low"
    assert [r.gt_record_id for r in runs.predictions(readers.run_records(loaded)).collect()] == [1]
    assert readers.evaluation_metrics(loaded).first().f1 == 1.0 and readers.run_listing(loaded).first().label == "20260101_000000_r.json"


def test_evaluation_sink_keeps_all_counters(spark, tmp_path):
    df = spark.createDataFrame([("1", "a")], "rid string, v string")
    aligned = align(df, df, "rid", config=EvalConfig(field_strategies={"v": FieldStrategy()}))
    sinks.write_evaluation(aligned, str(tmp_path / "e"))
    results, metrics, config = sinks.read_evaluation(spark, str(tmp_path / "e"), "rid")
    assert metrics.first().exact_matches == 1 and results.first().rid == "1" and config == aligned.config
    many = spark.range(3000).selectExpr("id AS rid", "IF(id = 1, 'a|b', 'x') AS v")
    sinks.write_markdown(many, str(tmp_path / "m"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "m" / "part=1")).collect()]
    assert len(lines) == 3000 and "| 1 | a\\|b |" in lines
    assert [r.value for r in spark.read.text(str(tmp_path / "m" / "part=0")).collect()] == ["| rid | v |", "| --- | --- |"]


def test_evaluation_sink_compares_records_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    count = F.udf(lambda v: calls.add(1) or v, "string").asNondeterministic()
    truth = spark.createDataFrame([(i, f"v{i % 3}", ["a", "b"][: i % 3] or None) for i in range(20)], "rid long, v string, items array<string>")
    pred = spark.createDataFrame([(i, f"v{i % 2}", ["b", "c"][: i % 2]) for i in range(5, 25)], "rid long, v string, items array<string>")
    config = EvalConfig(field_strategies={"v": FieldStrategy(), "items": FieldStrategy()})
    sinks.write_evaluation(align(truth, pred.withColumn("v", count("v")), "rid", config=config), str(tmp_path / "e"))
    assert calls.value == 20
    _, metrics, _ = sinks.read_evaluation(spark, str(tmp_path / "e"), "rid")
    want = field_metrics(align(truth, pred, "rid", config=config))
    assert [r.asDict() for r in metrics.select(*want.columns).collect()] == [r.asDict() for r in want.collect()]
    empty = align(truth.limit(0), pred.limit(0), "rid", config=config)
    sinks.write_evaluation(empty, str(tmp_path / "e"))
    assert sinks.read_evaluation(spark, str(tmp_path / "e"), "rid")[1].count() == 0


def test_grounding(spark):
    docs = spark.createDataFrame([(1, "We saw Canis lupus. Movement was high.", ["Canis lupus", "Ursus magnus"], ["canis  LUPUS"], ["traits"], None)],
                                 "id int, text string, gs array<string>, ps array<string>, gt array<string>, pt array<string>")
    rows = {(r.field, r.target_value): r for r in gr.comparison_table(docs, "id", "text", {"species": ("gs", "ps"), "data_type": ("gt", "pt")}).collect()}
    hit = rows["species", "Canis lupus"]
    assert (hit.bucket, hit.gt_support_type, hit.gt_quote, hit.pred_support_type) == ("match", "explicit", "We saw Canis lupus.", "explicit")
    assert (rows["species", "Ursus magnus"].bucket, rows["species", "Ursus magnus"].gt_support_type) == ("gt_only", "unsupported")
    assert rows["data_type", "traits"].gt_quote == "Movement was high."


def test_python_runs_once_in_a_plan(spark):
    import __spark_entry__ as entry

    for name in ("vector_topk", "vector_topk_filtered", "vector_distances", "tei_sections"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, name


def test_pending_work_runs_once_and_is_remembered(spark, tmp_path):
    registry = rg.Registry(spark, str(tmp_path / "reg"), buckets=4)
    registry.init()
    registry.upsert_documents(spark.createDataFrame([("w0",), ("w1",)], "work_id string").selectExpr(
        "work_id", "CAST(NULL AS STRING) AS pdf_sha256", "CAST(NULL AS STRING) AS source_path", "CAST(NULL AS STRING) AS doi", "'t' AS title",
        "CAST(NULL AS INT) AS publication_year", "'PENDING' AS status", "CAST(NULL AS STRING) AS parser_version",
        "CAST(NULL AS STRING) AS error_message", "current_timestamp() AS updated_at"))
    seen = spark.sparkContext.accumulator(0)

    def work(todo):
        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return todo.select("work_id").mapInArrow(count, "work_id string").selectExpr(
            "work_id", "IF(work_id = 'w3', 'broken', NULL) AS error_message")

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"work_id": f"w{i}"}) for i in range(4)))
    candidates = lambda: spark.readStream.schema("work_id string").json(str(tmp_path / "in"))
    registry_sync.process_pending(candidates(), registry, work, str(tmp_path / "cp")).awaitTermination(120)
    assert seen.value == 4
    state = {r.work_id: (r.status, r.title) for r in registry.documents().collect()}
    assert state == {"w0": ("PARSED", "t"), "w1": ("PARSED", "t"), "w2": ("PARSED", None), "w3": ("ERROR", None)}
    assert [r.work_id for r in registry.pending(spark.createDataFrame([(f"w{i}",) for i in range(4)], "work_id string"), ("PARSED",)).collect()] == ["w3"]
