"""Operator 13: gradients by finite differences, the reading of windows by a plain loop, held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pytest

from concordat.llm import toxicity as tx
from concordat.llm.grams import Block

TEXTS = [b"one two  three\nfour", b"", b"a " * 31 + b"end", b"x" * 300 + b" y", b"tail " * 33, "é ü 漢字".encode(), b" \n\t"]


def plain_logit(net, words):
    """One window, word by word and number by number."""
    w = {k: v.astype(float) for k, v in net.weights.items()}
    logistic = lambda v: 1 / (1 + np.exp(-v))
    vectors = []
    for word in words:
        block = Block([word])
        bucket = int((block.hash[0] * tx.BASE) >> np.uint64(64 - tx.WORD_BITS))
        marked = b" " + word + b" "
        grams = [((int.from_bytes(marked[i:i + 3], "big") * int(tx.BASE)) % 2 ** 64) >> (64 - tx.GRAM_BITS) for i in range(len(word))]
        vectors.append(np.concatenate([w["word"][bucket], w["gram"][grams].mean(0)]))
    states = [[None, None] for _ in words]
    for side, d in enumerate("fb"):
        h = np.zeros(tx.HIDDEN)
        for t in (range(len(words)) if d == "f" else reversed(range(len(words)))):
            x, back = vectors[t] @ w[f"in_{d}"] + w[f"shift_{d}"], h @ w[f"rec_{d}"]
            z, r = (logistic((x + back)[i * tx.HIDDEN:(i + 1) * tx.HIDDEN]) for i in (0, 1))
            n = np.tanh(x[2 * tx.HIDDEN:] + r * back[2 * tx.HIDDEN:])
            h = (1 - z) * n + z * h
            states[t][side] = h
    rows = [np.concatenate(s) for s in states]
    weight = np.array([math.exp(np.tanh(s @ w["look"]) @ w["query"]) for s in rows])
    pooled = sum((a * s for a, s in zip(weight / weight.sum(), rows)), np.zeros(2 * tx.HIDDEN)) if rows else np.zeros(2 * tx.HIDDEN)
    return float(pooled @ w["out"] + w["bias"][0])


def test_every_window_of_a_text_is_read():
    net = tx.Network.fresh(3)
    net.weights["bias"] += 0.25
    for text, got in zip(TEXTS, net.worst(TEXTS)):
        words = text.lower().split()
        starts = range(0, max(len(words) - tx.WINDOW, 0) + 1, tx.STRIDE)
        cut = [words[a:a + tx.WINDOW] for a in starts]
        if len(words) > tx.WINDOW and (len(words) - tx.WINDOW) % tx.STRIDE:
            cut.append(words[-tx.WINDOW:])
        assert got == pytest.approx(max(plain_logit(net, c) for c in cut), abs=2e-4)


def test_windows_overlap_and_cover():
    for n in range(200):
        _, first, size = tx.windows(np.array([n]))
        assert set().union(*(range(a, a + k) for a, k in zip(first, size))) == set(range(n))
        assert all(a + tx.STRIDE >= b for a, b in zip(first, first[1:]))


def test_gradients_by_finite_differences():
    net = tx.Network.fresh(4)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    data = tx.examples([[b"you are a fool", b"fool"], [b"fine words here", b""]], np.array([1.0, 0.0]))
    goal = np.array([1.0, 1.0, 0.0, 0.0])
    words, idx, there = data.part(np.arange(4))
    vectors = lambda: net.project(net.vectors(words).astype(np.float64))
    loss = lambda: float(np.log1p(np.exp(-(2 * goal - 1) * net.read(vectors(), idx, there))).sum())
    g = net.gradient(words, idx, there, lambda z: 1 / (1 + np.exp(-z)) - goal)
    r = np.random.default_rng(0)
    for name, w in net.weights.items():
        touched = np.argwhere(np.abs(g[name]) > 1e-4)
        for at in touched[r.permutation(len(touched))[:6]]:
            at, keep = tuple(at), w[tuple(at)]
            w[at] = keep + 1e-2
            up = loss()
            w[at] = keep - 1e-2
            down = loss()
            w[at] = keep
            assert g[name][at] == pytest.approx((up - down) / 2e-2, rel=0.03, abs=2e-3), name


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghimnorstu") for _ in range(r.randint(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(700):
        words = [r.choice(vocabulary) for _ in range(r.randint(20, 150))]
        if i % 3 == 0:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["vilezork", "vilezorks", "grubfink", "Grubfink"])
        rows.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, 1, int(i % 3 == 0)))
    folder = str(tmp_path_factory.mktemp("toxic"))
    extra = [(1000, None, None, None, 0), (1001, "", "en", "a", 0), (1001, "", "en", "a", 0), (None, "vilezork", "en", "a", 0),
             (1002, "word " * 30_000 + "grubfink " * 3, "en", "a", 1)]
    spark.createDataFrame(rows + extra, "doc_id long, text string, score string, held_out string, label int").write.parquet(
        f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, labels


def test_held_out_accuracy_and_edge_cases(spark, tables):
    folder, rows, labels = tables
    out = tx.op13_toxicity(spark, folder)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) + 5 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got)
    by_id = {x["doc_id"]: x for x in got}
    held = [i for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by_id[i]["held_out"] for i in held) and sum(x["held_out"] for x in got if (x["doc_id"] or 0) < 700) == len(held) + 1
    right = sum(by_id[i]["predicted"] == int(i % 3 == 0) for i in held) / len(held)
    assert right > 0.95, right
    assert by_id[1000]["predicted"] == by_id[1001]["predicted"] == 0 and by_id[1002]["predicted"] == 1
    again = {x["doc_id"]: x["score"] for x in tx.op13_toxicity(spark, folder).collect()}
    assert all(abs(again[i] - x["score"]) < 1e-6 for i, x in by_id.items())


def test_labels_of_held_out_rows_are_never_read(spark, tables):
    folder, _, labels = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60")
    schema = "doc_id long, toxic int"
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, _, t in labels]
    scores = [sorted(map(tuple, tx.toxicity(docs, spark.createDataFrame(x, schema)).select("doc_id", "score").collect()))
              for x in ([(i, t) for i, _, t in labels], turned)]
    assert [s[0] for s in scores[0]] == [s[0] for s in scores[1]]
    assert np.allclose([s[1] for s in scores[0]], [s[1] for s in scores[1]], atol=1e-6)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {x["score"] for x in tx.toxicity(docs, none).collect()} == {0.0}
    one = spark.createDataFrame([(i, 1) for i in range(1, 9)], "doc_id long, toxic int")
    assert {x["predicted"] for x in tx.toxicity(docs, one).collect()} == {1}
    assert tx.toxicity(docs.where("false"), none).count() == 0
