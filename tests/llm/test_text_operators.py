"""Token counts, packing, secret scans, URL filter and quality operators against plain versions of their rules."""

import base64
import gzip
import re
import zlib
from urllib.parse import quote

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from concordat.llm import labelled, packing, quality_rank, quality_rules, secret_scan, token_counts, url_filter

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LIBRARY = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab'srevmltd 1!\n\té <|endoftext>漢"), st.characters(
    exclude_categories=("Cs",))), max_size=40), min_size=1, max_size=5))
def test_counts_are_the_library_s(texts):
    cascade = token_counts.compiled(token_counts.VOCABULARY)
    assert cascade.count(texts).tolist() == [len(ids(t)) for t in texts]


def test_chunks_compose_at_any_length():
    cascade = token_counts.compiled(token_counts.VOCABULARY)
    text = "it's  we'll\n\n don't ''re 12 ab!!  \n x" * 20
    points = np.frombuffer((text + "\0").encode("utf-32-le"), np.uint32)
    classes = cascade.classes.of(points)
    classes[-1] = token_counts.END
    want = token_counts.boundaries(classes, len(classes)).tolist()
    assert all(token_counts.boundaries(classes, k).tolist() == want for k in (1, 2, 3, 7, 64))
    assert want[:-1] == [a for _, (a, _) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]


def test_token_query(spark):
    got = {r["doc_id"]: r for r in token_counts.op3_token_counts(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        mine = got[r["doc_id"]]
        assert (mine["n_bytes"], mine["n_tokens"]) == (len(r["text"].encode()), len(ids(r["text"])))
        assert mine["over_limit"] == (mine["n_tokens"] > 512)


def test_packing_round_trip(spark):
    got = packing.op2_packing(spark, SF).toPandas()
    by_doc = dict(list(got.groupby("doc_id")))
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        whole, at = np.array([*ids(r["text"]), 0], "<u4"), 0
        for p in by_doc[r["doc_id"]].sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(whole)
            assert zlib.crc32(whole[at:at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(whole)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == (s["length"].cumsum() - s["length"]).tolist() and s["length"].sum() <= 1024
    assert got["sequence_id"].nunique() * 1024 < 1.03 * got["length"].sum()


def test_cutting_stock_is_near_its_bound():
    draw = np.random.default_rng(1)
    sizes, demand = np.unique(draw.integers(1, 129, 4000), return_counts=True)
    patterns, used = packing.cutting_stock(128, sizes, demand.astype(float), 0.002)
    assert (sizes @ patterns <= 128).all() and np.allclose(patterns @ used, demand)
    assert used.sum() <= 1.01 * (sizes * demand).sum() / 128
    times = packing.whole_sequences(patterns, used, demand)
    assert (patterns @ times <= demand).all() and times.sum() >= used.sum() - len(sizes)


def test_first_fit_fills_bins():
    lengths = [700, 600, 400, 324, 300, 24, 1024]
    bins = packing.first_fit(lengths, 1024)
    room = {}
    for b, n in zip(bins, lengths):
        room[b] = room.get(b, 0) + n
    assert max(room.values()) <= 1024 and len(room) == 4


def slow_base(text):
    found = []
    for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
                         r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (kind, pattern, least) in enumerate([("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16)], 1):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return ",".join(s for *_, s in sorted(found))


def test_secret_query(spark):
    got = {r["doc_id"]: r for r in secret_scan.op5_secrets(spark, MORE).collect()}
    from hashlib import sha256

    for r in spark.read.parquet(f"{MORE}/documents.parquet").collect():
        want = slow_base(r["text"])
        assert got[r["doc_id"]]["base_sha256"] == sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[r["doc_id"]]["spans"].split(","))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="token secrtapiky_'=: \"ABCDEF0123456789AKIAſK%\\u&#;", max_size=80))
def test_base_patterns(text):
    assert secret_scan.listed(secret_scan.scan(text, text.encode())) == slow_base(text)


SECRET = "password=abcdefghij12345"


@pytest.mark.parametrize("wrap", [
    lambda s: base64.b64encode(s.encode()).decode(), lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
    lambda s: quote(s, safe=""), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: "".join(f"&#{ord(c)};" for c in s),
    lambda s: base64.b64encode(gzip.compress(s.encode())).decode(), lambda s: base64.b64encode(zlib.compress(s.encode())).decode()])
def test_layers_unwrap_to_the_place_of_their_text(wrap):
    for layers in (1, 2):
        coded = SECRET
        for _ in range(layers):
            coded = wrap(coded)
        text = f"é before {coded} after"
        base, spans, _ = secret_scan.find(text.encode())
        mine = [s for s in spans if s[0] == "assign" and s not in base]
        assert len(mine) >= (1 if coded != SECRET else 0)
        at = text.index(coded)
        assert all(at <= a < b <= at + len(coded) for _, a, b in mine)


def test_partly_encoded_span_and_bomb():
    text = "x token%3Dabcdefghijklmnop y"
    _, spans, _ = secret_scan.find(text.encode())
    assert ("assign", 2, 26) in spans
    bomb = base64.b64encode(gzip.compress(b"a" * 100_000)).decode()
    assert secret_scan.find(bomb.encode(), max_layer=1000)[2] == 1


def test_redaction(spark):
    df = spark.createDataFrame([(1, f"a {SECRET} b", 26), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    assert sorted(map(tuple, secret_scan.redact(df).collect())) == [(1, "a [secret] b", 12), (2, "clean", 5), (3, None, None)]


def test_url_query(spark):
    got = {r["page_id"]: r for r in url_filter.op4_url_filter(spark, MORE).collect()}
    for r in spark.read.parquet(f"{MORE}/pages.parquet").select("page_id", "url").collect():
        rest = r["url"].split("://", 1)[1] if "://" in r["url"] else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(rule), rule, verdict) for verdict, rule in url_filter.RULES
                if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith(rule[rule.index("/"):])]
        mine = got[r["page_id"]]
        assert (mine["host"], mine["path"], mine["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert mine["verdict"] == max(fits)[2] if fits else mine["verdict"] in ("allow", "block")


def test_url_model_learns_its_labels(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 9}.{'com/' if i % 2 else 'net/es/'}{'x' * (i % 5)}{i}") for i in range(400)],
                                  "page_id long, url string")
    taught = url_filter.judge(pages.unionAll(spark.createDataFrame(
        [(1000, "http://new.com"), (1001, "http://new.net/de/3")], "page_id long, url string")))
    got = {r["page_id"]: r["verdict"] for r in taught.where("page_id >= 1000").collect()}
    assert got == {1000: "allow", 1001: "block"}


def test_base_counts(spark):
    got = {r["doc_id"]: r for r in quality_rules.op9_quality_rules(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in r["text"].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        mine = got[r["doc_id"]]
        assert (mine["n_words"], mine["word_chars"], mine["n_symbols"], mine["n_dup_lines"], mine["n_repeat_words"]) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r["text"])), len(lines) - len(set(lines)), len(marked))
        failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
        assert mine["base_failed"] == failed and not (failed and mine["kept"])


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{MORE}/labels.parquet").toPandas()
    held = labels["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)
    ranked = quality_rank.op8_quality_rank(spark, MORE).toPandas()
    both = ranked.merge(labels[held], on="doc_id")
    assert both["held_out"].all() and (both["predicted"] == both["quality"]).mean() > 0.95
    assert ranked["score"].between(0, 1).all()
    ruled = quality_rules.op9_quality_rules(spark, MORE).toPandas().merge(labels[held], on="doc_id")
    ruled = ruled[~ruled["base_failed"]]
    assert (ruled["kept"] == (ruled["quality"] == 1)).mean() > 0.95
    again = quality_rank.op8_quality_rank(spark, MORE).toPandas()
    assert pd.testing.assert_frame_equal(*(d.sort_values("doc_id").reset_index(drop=True) for d in (ranked, again))) is None


def test_every_labelled_row_teaches_the_rank(spark):
    # Good texts that look bad but for one word; in the order of a hash of the ids they come after 4,000 others.
    ids = spark.range(5_700).withColumn("held", labelled.fold("id") == 0).withColumn("place", F.row_number().over(
        Window.partitionBy("held").orderBy(F.xxhash64(F.lit(17), "id"), "id")))
    kind = F.when(F.when(F.col("held"), F.col("id") % 5 == 0).otherwise(F.col("place") > 4_000), "odd").when(
        F.col("id") % 2 == 0, "good").otherwise("bad")
    docs = ids.withColumn("kind", kind).select(F.col("id").alias("doc_id"), "kind", F.when(F.col("kind") == "good", "alpha beta gamma").when(
        F.col("kind") == "bad", "omega psi chi").otherwise("omega psi chi zzzz").alias("text"))
    labels = docs.select("doc_id", F.when(F.col("kind") == "bad", 0).otherwise(1).alias("quality"))
    got = quality_rank.rank(docs, labels).join(docs, "doc_id").where("held_out").groupBy("kind").agg(F.avg("predicted").alias("p")).collect()
    assert {r["kind"]: r["p"] for r in got} == {"good": 1, "bad": 0, "odd": 1}


@pytest.mark.parametrize("layer", [
    f"prix\u00a0: {SECRET}".encode(), f"\ufeff{SECRET}".encode(), f"a\0b\f\x1b {SECRET}".encode(), b"\xff\xfe caf\xe9 " + SECRET.encode(),
    f"caf\xe9 {SECRET}".encode("latin-1"), SECRET.encode("utf-16"), SECRET.encode("utf-16-be"), f"{SECRET} \u202f ".encode("utf-16-le"),
    gzip.compress(b"first ") + gzip.compress(SECRET.encode()), gzip.compress(f"\u00a0 {SECRET}".encode())])
def test_every_decoded_layer_is_scanned(layer):
    coded = base64.b64encode(layer).decode()
    for before in ("", "/cb/", "key_", "x", "ab-"):
        text = f"see {before}{coded} after"
        _, spans, _ = secret_scan.find(text.encode())
        at = text.index(coded)
        assert any(k == "assign" and at - len(before) <= a < b <= at + len(coded) for k, a, b in spans), before
    nested = base64.b64encode("\u00a0".encode() + coded.encode()).decode()
    assert any(k == "assign" for k, *_ in secret_scan.find(nested.encode())[1])


@pytest.mark.parametrize("line_end", ("\n", "\r\n", "\n  ", "\\n", "\\r\\n"))
def test_wrapped_base64_maps_back(line_end):
    coded = base64.b64encode(f"{'x' * 40} {SECRET} end".encode()).decode()
    text = "see " + line_end.join(coded[k:k + 64] for k in range(0, len(coded), 64)) + " after"
    _, spans, _ = secret_scan.find(text.encode())
    whole = base64.b64decode(coded).index(SECRET.encode()) * 8 // 6
    assert any(k == "assign" and a == 4 + whole and b > 4 + 64 + len(line_end) for k, a, b in spans)
