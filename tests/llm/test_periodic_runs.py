"""Operator 11 against brute force."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from concordat.llm import periodic_runs


def brute(words, shortest=12):
    """Every period in turn; a stretch that has it is a run if no smaller period fits."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(shortest, 2 * q):
                part = words[i:j + q]
                if not any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def repetitive(seed):
    r = random.Random(seed)
    words = []
    while len(words) < 90:
        base = [r.randrange(r.choice([1, 2, 3, 30])) for _ in range(r.randint(1, 14))]
        words += (base * 4)[:r.randint(1, 3 * len(base) + 2)]
    return words[:r.randint(0, 90)]


@pytest.mark.parametrize("shortest", [2, 4, 12])
def test_automaton_against_brute_force(shortest):
    for seed in range(400):
        words = repetitive(seed)
        assert periodic_runs.runs(words, shortest) == brute(words, shortest), words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=50), max_size=4))
def test_filter_loses_no_run(texts):
    raw = [" ".join(str(w) for w in t).encode() for t in texts]
    got = periodic_runs.runs_of_block(raw, lambda i, n: None)
    assert [g[0] for g in got] == [brute(t) for t in texts]


def test_known_shapes():
    assert periodic_runs.runs([7] * 500) == [(0, 500, 1)]
    f, g = [0], [0, 1]
    for _ in range(9):
        f, g = g, g + f
    assert periodic_runs.runs(g) == brute(g)
    assert periodic_runs.runs(list(range(300)) * 2) == [(0, 600, 300)]
    assert periodic_runs.runs(list(range(12)) + list(range(11))) == []


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(kept)).hexdigest())


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, " \n".join("w%d" % w for w in repetitive(i)) if i % 3 else " ".join(str(r.randrange(50)) for _ in range(80)))
            for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "\t \n"), (None, "a b " * 30), (7, "x " * 40), (7, "x " * 40), (1003, "é b " * 20)]
    rows = [(*row, "x", "y") for row in rows]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, period string").repartition(3).write.parquet(
        f"{tmp_path}/documents.parquet")
    out = periodic_runs.op11_periodic_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(map(tuple, out.collect()), key=lambda x: key((x[0], str(x[1:])))) == sorted(
        ((i, *expected(i, t)) for i, t, *_ in rows), key=lambda x: key((x[0], str(x[1:]))))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(300)) > 10


def test_operator_keeps_its_own_interface(spark):
    df = spark.createDataFrame([(1, "one two three four " * 5 + "end"), (2, "plain words only")], "doc_id long, text string")
    got = {x["doc_id"]: x for x in periodic_runs.periodic_runs(df).collect()}
    assert got[1]["collapsed"] == "one two three four end" and [tuple(x) for x in got[1]["runs"]] == [(0, 20, 4)]
    assert got[2]["collapsed"] == "plain words only" and got[2]["n_runs"] == 0
    assert periodic_runs.periodic_runs(df.where("false")).count() == 0
