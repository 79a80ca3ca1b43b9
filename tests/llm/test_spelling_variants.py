"""Operator 12 against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from concordat.llm import spelling_variants as sv

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute_words(rows, every=199, shortest=6, least=5):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= least}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, times=5, **settings):
    n = brute_words(rows, **settings)
    near = {w: [v for v in n if v != w and is_near(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return sorted(out)


def misspelt(seed, number=60):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdéñÿÀ") for _ in range(r.randint(5, 9))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "aaaaaab"]
    rows = []
    for i in range(number):
        words = []
        for _ in range(60):
            w = list(r.choice(base[:4]) if r.random() < .7 else r.choice(base))
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
                j, what = r.randrange(len(w)), r.randrange(3)
                w[j:j + (what > 0)] = [] if what == 2 else r.choice("ab")
            words.append("".join(w).replace("b", r.choice("bB")))
        rows.append((i, r.choice([" ", ", ", "1", "Ā", "­"]).join(words)))
    return rows


def test_query_against_brute_force(spark, tmp_path):
    rows = misspelt(1) + [(800 + i, "chainword " * 20 + "chainwore " * (i % 4) + "chaimwore " * (i % 9 == 0)) for i in range(40)]
    rows += [(900, None), (901, ""), (None, "Loneword " * 6), (902, "×÷×÷×÷ " * 5),
                          (903, "repeated " * 400), (903, "repeated " * 400)]
    spark.createDataFrame([(*x, "x", 1) for x in rows], "doc_id long, text string, key string, n int").repartition(4).write.parquet(
        f"{tmp_path}/documents.parquet")
    out = sv.op12_spelling_variants(spark, str(tmp_path))
    assert out.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    got = sorted(map(tuple, out.collect()))
    assert got == brute(rows)
    assert sum(x[3] is not None for x in got) > 20 and any(x[5] != (x[3] or x[0]) for x in got)
    assert brute(rows) != brute(rows, every=None)  # the planted deletions change the result


def test_results_do_not_depend_on_the_filters(spark):
    rows = misspelt(2, 30)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bits, size in ((14, 1 << 20), (1, 64)):
        got = sorted(map(tuple, sv.variants(df, times=2, least=3, drop_every=7, bits=bits, filter_bytes=size).collect()))
        assert got == brute(rows, times=2, least=3, every=7)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "rare words only"), (2, None)], "doc_id long, text string")
    assert sv.variants(df).count() == 0 and sv.variants(df.where("false")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abÀÿ", min_size=1, max_size=9), min_size=1, max_size=6, unique=True))
def test_hashes_of_edits(words):
    w = sv.Words(pa.array([x.encode("latin-1") for x in words], pa.binary()))
    at, value = w.deletions()
    gone = [x.decode("latin-1") for x in w.edited(at, np.zeros(len(at), np.uint8)).to_pylist()]
    want = {(i, x[:j] + x[j + 1:]) for i, x in enumerate(words) for j in range(len(x))}
    assert sorted(zip(w.word[at].tolist(), gone)) == sorted(want)
    direct = sv.Words(pa.array([x.encode("latin-1") for x in gone], pa.binary()))
    assert (direct.hash == value).all()
    every = np.arange(len(w.letter))
    swapped = w.edited(every, np.full(len(every), 0xE9, np.uint8))
    assert (sv.Words(swapped).hash == w.replaced(every, 0xE9)).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=20), max_size=20), st.binary(max_size=9))
def test_crc(parts, before):
    raw = np.frombuffer(b"".join(parts) + b"x", np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    begin = np.cumsum(size) - size
    got = sv.crc_on(np.full(len(parts), zlib.crc32(before), np.uint32), raw, begin, begin + size)
    assert got.tolist() == [zlib.crc32(before + p) for p in parts]


def test_long_runs_and_counts():
    long = "ab" * 400
    text = f"{long} short Word word WORD {'é' * 7} İstanbul"
    for i in range(40):
        got = {k.decode("latin-1"): v for k, v in sv.counted([b"", text.encode()], ["0", str(i)], 3, 4).items()}
        assert got == brute_words([(i, text)], every=3, shortest=4, least=1)
