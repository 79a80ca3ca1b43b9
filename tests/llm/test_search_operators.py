"""Near-duplicate operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordat.llm import embedding_dedup, links, simhash

SF = "/root/testdata/sf0.001"


def parts(n, pairs):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return [top(i) for i in range(n)]


def test_components(spark):
    draw = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in draw.integers(0, 200, (120, 2))] + [(i, i + 1) for i in range(300, 340)]
    pairs += [(400, i) for i in range(401, 460)]
    got = dict(links.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    want = parts(460, pairs)
    assert got == {i: want[i] for i in {x for a, b in pairs for x in (a, b) if a != b}}


@pytest.mark.parametrize("radius", (0, 1, 2))
@pytest.mark.parametrize("hot", (256, 1))
def test_fingerprint_links(spark, radius, hot):
    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 63, 40, dtype=np.uint64) | (draw.integers(0, 2, 40, dtype=np.uint64) << np.uint64(63))
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(6):
            for bit in draw.integers(0, 64, draw.integers(1, 4)):
                b ^= 1 << int(bit)
            fps.add(b)
    fps = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    want = parts(len(fps), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    signed = fps.view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    roots = dict(links.components(simhash.links(df, radius, hot)).collect())
    got = [roots.get(int(x), int(x)) for x in signed]
    groups = lambda v: sorted(tuple(np.flatnonzero(np.array(v) == x)) for x in set(v))
    assert groups(got) == groups(want)


@pytest.mark.parametrize("n,radius", [(100, 2), (10 ** 6, 2), (10 ** 10, 2), (10 ** 6, 1)])
def test_thresholds_meet_the_pigeonhole_sum(n, radius):
    draw = np.random.default_rng(3)
    bits = draw.random((500, 64)) < draw.random(64)
    bits[:, 1] = bits[:, 0]
    counts = bits.astype(float).T @ bits * (n / 500)
    groups = simhash.plan(counts, n, radius)
    assert groups and all(0 <= t <= radius for _, t in groups)
    # A group at -1 is left out; each counts one less. Any pair within the radius meets a threshold.
    for _ in range(300):
        differ = set(draw.choice(64, radius, replace=False).tolist())
        assert any(len(differ & set(g)) <= t for g, t in groups)


def test_query_matches_brute_force(spark):
    got = {r["doc_id"]: r for r in simhash.op1_simhash(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = np.array([slow_fingerprint(r["text"]) for r in docs], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    want = parts(len(docs), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    for i, r in enumerate(docs):
        assert got[r["doc_id"]]["fingerprint"] == f"{int(fps[i]):016x}"
        assert got[r["doc_id"]]["component_id"] == docs[want[i]]["doc_id"]


def slow_fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


@pytest.mark.parametrize("cap", (2000, 60))
def test_embedding_links(spark, cap):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(300, 16))
    copies = np.repeat(x[:20], 6, axis=0) + draw.normal(size=(120, 16)) * 0.05
    group = x[50] + draw.normal(size=(150, 16)) * 0.06
    x = np.concatenate([x, copies, group, x[:5]])
    label = draw.integers(0, 2, len(x))
    label[300:420] = np.repeat(label[:20], 6)
    label[420:570] = label[50]
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, cap=cap).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    true = link.sum(1)
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum()
    assert sum(r["audited_found"] or 0 for r in got.values()) >= 0.95 * sum(r["audited_true"] or 0 for r in got.values())
    if cap == 2000:
        want = parts(len(x), [(a, b) for a, b in zip(*np.nonzero(link)) if a < b])
        assert [got[i]["component_id"] for i in range(len(x))] == want
        assert all(got[i]["kept"] == (want[i] == i) for i in range(len(x)))


def test_flat_graph_reaches_all_nodes():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = embedding_dedup.flat_graph(x, 12, 1.3)
    assert graph.shape == (200, 12) and not (graph == np.arange(200)[:, None]).any()
    hits = embedding_dedup.in_range(x, graph, np.arange(200), np.array([0]), 0.8, 0.1, 16, 200)
    true = x @ x.T >= 0.8
    assert (hits & ~true).sum() == 0 and (hits & true).sum() >= 0.95 * true.sum()


def test_similar_groups_are_those_of_verified_pairs(spark):
    draw = np.random.default_rng(6)
    words = [f"w{i}" for i in range(400)]
    base = [list(draw.choice(words, 300)) for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for edits in (1, 2, 4, 40):
            copy = list(b)
            for at in draw.integers(0, 300, edits):
                copy[at] = "new"
            texts.append(" ".join(copy))
    texts += ["a b c", "A  b c", "a b d", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in texts)]
    near = [(i, j) for j in range(len(texts)) for i in range(j)
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = parts(len(texts), near)
    got = dict(simhash.similar_groups(docs).select("doc_id", "component_id").collect())
    assert [got[i] for i in range(len(texts))] == want


def test_spanning_pairs_connect_a_bucket():
    draw = np.random.default_rng(7)
    fps = draw.integers(0, 1 << 12, 300, dtype=np.uint64)
    a, b = simhash.spanning(np.arange(300), fps, 1)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 1
    assert parts(300, list(zip(a, b))) == parts(300, [(i, j) for i, j in zip(*np.nonzero(near)) if i < j])
    assert near[a, b].all()


@pytest.mark.parametrize("bucket", (1024, 40))
def test_star_of_copies_is_one_group(spark, bucket):
    draw = np.random.default_rng(8)
    base = [f"w{i}" for i in range(250)]
    texts = [" ".join(base)]
    for k in range(150):
        copy = list(base)
        for at in draw.choice(np.arange(5, 245, 6), 5, replace=False):
            copy[at] = f"n{k}x{at}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    near = [(i, j) for j in range(len(texts)) for i in range(j) if alike(i, j)]
    fps = np.array([simhash.fingerprint(t.encode(), 2) for t in texts], np.uint64)
    found = [(i, j) for i, j in near if np.bitwise_count(fps[i] ^ fps[j]) <= 10]
    got = dict(simhash.similar_groups(docs, bucket=bucket).select("doc_id", "component_id").collect())
    assert [got[i] for i in range(len(texts))] == parts(len(texts), found) and len(near) >= 150


def test_chosen_pairs_of_sides_and_labels():
    draw = np.random.default_rng(9)
    fps = draw.integers(0, 1 << 10, 200, dtype=np.uint64)
    label, side = draw.integers(0, 5, 200), draw.integers(0, 2, 200)
    i, j, rest = simhash.choose(fps, label, 2, 200, side)
    near = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2) & (label[:, None] != label) & (side[:, None] < side)
    assert set(zip(i, j)) == set(zip(*np.nonzero(near))) and not len(rest)


def test_a_large_bucket_is_dealt_to_blocks(spark):
    labels = [1] * 300 + [2] * 120 + list(range(10, 90))
    keys = spark.createDataFrame([(0, 7, i, i, c) for i, c in enumerate(labels)], "part int, key long, node long, fp long, label long")
    rows = simhash._all_blocks(keys, 50).toPandas()
    met = set()
    for _, block in rows.groupby("block"):
        assert len(block) <= 200
        sides = [block.loc[block["side"] == k, "node"].tolist() for k in (0, 1, 2)]
        met |= {(min(a, b), max(a, b)) for x, y in ((sides[0], sides[1]), (sides[2], sides[2])) for a in x for b in y}
    assert {(i, j) for j in range(len(labels)) for i in range(j) if labels[i] != labels[j]} <= met
    assert simhash._all_blocks(keys.where("label = 1"), 50).count() == 0


@pytest.mark.parametrize("spread", (1024, 7))
def test_exact_filter_loses_no_similar_pair(spark, spread):
    draw = np.random.default_rng(11)
    base = [draw.choice(10_000, 60, replace=False) for _ in range(4)]
    sets = []
    for k in range(160):
        s = list(base[k % 4])
        for at in draw.choice(60, draw.integers(0, 12), replace=False):
            s[at] = 20_000 + draw.integers(0, 400)
        sets.append(sorted({int(x) for x in s[:draw.integers(45, 61)]}))
    label = draw.integers(0, 6, len(sets)).tolist()
    fps = (draw.integers(0, 1 << 6, len(sets))).tolist()
    df = spark.createDataFrame(list(zip(range(len(sets)), fps, label, sets)), "node long, fp long, label long, hashes array<long>")
    alike = lambda a, b: len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))
    apart = {(i, j) for i in range(len(sets)) for j in range(i) if label[i] != label[j] and (fps[i] ^ fps[j]).bit_count() <= 3}
    got = {(max(r), min(r)) for r in map(tuple, simhash._may_be_similar(df, 0.8, 3, spread).collect())}
    want = {p for p in apart if alike(*p)}
    assert want <= got <= apart and len(want) > 100 and len(got) < len(apart) / 2
    assert simhash._may_be_similar(df.withColumn("label", df.node * 0), 0.8, 3).count() == 0


def test_a_crowd_below_the_similarity_brings_few_pairs(spark):
    # Copies within 10 bits of each other whose own words make every two of them less than 0.8 alike.
    base = [f"w{i}" for i in range(250)]
    texts = [" ".join(f"n{k}x{i}" if i % 25 == 7 else w for i, w in enumerate(base)) for k in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = spark.createDataFrame([(k, int(simhash.sequence_hashes([t.encode()])[0].as_py())) for k, t in enumerate(texts)],
                                  "first long, node long").withColumn("fp", F.lit(0).cast("long")).withColumn("label", F.col("node"))
    sets = simhash._sets(docs, nodes, nodes, 5).join(nodes, "node")
    assert simhash._may_be_similar(sets, 0.8, 10).count() == 0
    got = dict(simhash.similar_groups(docs, bucket=50).select("doc_id", "component_id").collect())
    assert got == {k: k for k in range(120)}


def test_links_within_and_between_groups_cost_one_edge(spark, monkeypatch):
    halves = [(i, 0 if i < 40 else 40) for i in range(80)] + [(90, 90), (91, 90)]
    pairs = [(i, j) for i in range(80) for j in range(i)] + [(91, 95), (96, 97), (97, 97)]
    seen, star = [], links._star
    monkeypatch.setattr(links, "_star", lambda edges, large: seen.append(edges.count()) or star(edges, large))
    roots = spark.createDataFrame(halves, "node long, root long")
    got = dict(links.extended(roots, spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(80), 0), 90: 90, 91: 90, 95: 90, 96: 96, 97: 96}
    assert max(seen, default=0) <= 3


def test_some_pairs_join_a_large_group(spark):
    draw = np.random.default_rng(12)
    base = draw.choice(10_000, 60, replace=False).tolist()
    sets = [sorted({*draw.choice(base, 58, replace=False).tolist(), 20_000 + k}) for k in range(150)]
    df = spark.createDataFrame([(k, 0, k, s) for k, s in enumerate(sets)], "node long, fp long, label long, hashes array<long>")
    rows = simhash._prefixes(df, 0.8).join(df.select("node", "label"), "node")
    everything = {frozenset(r) for r in map(tuple, simhash._may_be_similar(df, 0.8, 3).collect())}
    for spread in (1024, 20):
        tried = simhash._tried(rows, 0.8, 3, 0, 4, spread)
        found = {frozenset(r) for r in map(tuple, tried.collect())}
        assert found <= everything and len(found) <= 8 * 150 < len(everything) / 5
        assert links.components(simhash._of_similarity(df, tried, 0.8)).where("root = 0").count() > 100


def test_a_dense_group_meets_in_bounded_blocks(spark):
    draw = np.random.default_rng(10)
    x = draw.normal(size=16) + draw.normal(size=(700, 16)) * 0.03
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, cap=60).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert [got[i]["n_links"] for i in range(700)] == ((u @ u.T >= 0.98).sum(1) - 1).tolist()
    assert {r["component_id"] for r in got.values()} == {0}
    nodes = spark.createDataFrame([(i, 1, False, v.tolist(), 1) for i, v in enumerate(x)],
                                  "node long, n long, audited boolean, vec array<double>, label int")
    frame = embedding_dedup.shards(nodes, 60, 3, float(np.sqrt(0.04)))
    home, visit = (b.groupBy("shard", "_h", "_v").count().toPandas() for b in embedding_dedup.visit_blocks(frame, 64))
    assert frame.groupBy("shard").count().agg({"count": "max"}).first()[0] >= 600
    assert max(home["count"].max(), visit["count"].max()) <= 128
    assert set(map(tuple, home[["shard", "_h", "_v"]].values)) == set(map(tuple, visit[["shard", "_h", "_v"]].values))


def test_a_search_step_ranks_only_what_it_looked_at(monkeypatch):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(40, 16))[draw.integers(0, 40, 600)] + 0.05 * draw.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, queries, cells, partition = embedding_dedup.flat_graph(x, 16, 1.3), np.arange(100), [], np.partition
    monkeypatch.setattr(embedding_dedup.np, "partition", lambda a, *args, **kw: cells.append(a.size) or partition(a, *args, **kw))
    hits = embedding_dedup.in_range(x, graph, queries, np.array([0, 300, 599]), 0.98, 0.05, 8, 24)
    assert np.array_equal(hits, hits & (x[queries] @ x.T >= 0.98 - 1e-12)) and hits.sum() >= 0.95 * (x[queries] @ x.T >= 0.98).sum()
    assert len(cells) > 3 and sum(cells) < 2 * 100 * 600
