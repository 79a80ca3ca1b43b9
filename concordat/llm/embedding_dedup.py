"""Operator 10, embedding near-duplicates by a robust-pruned flat graph.

Vectors are compared within their label. Equal vectors are one node from the
start. The nodes of a label are split by k-means (fitted on bounded samples)
into cluster shards until none is home to more than ``cap``; a node goes to its
``overlap`` nearest clusters, home to the nearest. Where a dense group is itself
split (centroids closer than ``CLOSE``), a node also visits every shard on whose
border it lies, near enough for a link across it; homes and visitors meet in
pairs of blocks of bounded size, all compared. In every shard a flat graph
is built, of its own and overlapping nodes: nearest neighbours and the nodes that name a node as theirs, pruned so
that an edge is kept only if no kept one leads closer by the factor ``alpha``.
The adjacency lists of a node from all its shards are united.

Each home node is then a query in its shard, over the united graph: greedy
search with a beam from the medoids, then expansion of the range - every node
found within the threshold, less a slack, opens its neighbours - until it stops
growing. Cosines are verified in double precision. Queries with an id divisible
by ``audit_every`` are compared with all nodes of the shard; a shard whose
audited recall is under ``recall`` is scanned in blocks instead.

Links are counted in the task, not written: a shard returns each home node's
number of links and one row for each linked node with the least node of its
part, so a group of thousands of near copies makes thousands of rows.

Edge cases: vectors that are null, zero, or hold nulls or non-finite numbers,
and vectors without a label, link with nothing and are kept; vectors of other
lengths are compared with their like; repeated rows are linked to each other;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordat.llm.common import pinned
from concordat.llm.links import components, merged

FANOUT, SAMPLE_PER_CHILD, SALT_ROWS = 32, 32, 5_000
DEPTH = 8
#: Cosine of two centroids from which they are taken to split one dense group.
CLOSE = 0.8
#: Home of a node, overlapping shard, and shard that it only visits.
HOME, OVERLAP, VISIT = range(3)
#: Queries times nodes that a search looks at together.
BLOCK_CELLS = 1 << 20
#: Rows of a block of homes or visitors, about.
VISIT_ROWS = 2048


def unit(rows: pd.Series) -> np.ndarray:
    x = np.array(rows.tolist(), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids; the first k rows, which come in order of a hash, are the start."""
    centres = x[:k].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def children(x: np.ndarray, kind: np.ndarray, centres: np.ndarray, overlap: int, reach: float) -> tuple[np.ndarray, ...]:
    """(row, child, kind) of every child shard that a row goes to; ``reach``: the longest chord of a link.

    A link across the plane half-way between two centroids has both ends within
    its own length of that plane.
    """
    near, among = x @ centres.T, centres @ centres.T
    order = np.argsort(-near, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    best, rows = order[:, 0], np.arange(len(x))
    apart = np.sqrt(np.maximum(2 - 2 * among[best], 1e-18))
    border = (among[best] >= CLOSE) & (near[rows, best][:, None] - near <= reach * apart)
    row, child = np.nonzero((rank < overlap) | border)
    level = np.where(rank[row, child] == 0, HOME, np.where(rank[row, child] < overlap, OVERLAP, VISIT))
    return row, child, np.maximum(level, kind[row])


def shards(nodes: DataFrame, cap: int, overlap: int, reach: float) -> DataFrame:
    """(node, n, audited, vec, shard, kind): every node in its cluster shards."""
    frame = nodes.select("node", "n", "audited", "vec", F.concat_ws(":", "label", F.size("vec")).alias("shard"),
                         F.lit(HOME).alias("kind"))
    columns = frame.columns
    for _ in range(DEPTH):
        big = pinned(frame.groupBy("shard").agg(F.count_if(F.col("kind") == HOME).alias("count"), F.count("*").alias("_all")).where(
            F.col("count") > cap))
        if big.isEmpty():
            break
        big = big.withColumn("_k", F.least(F.lit(FANOUT), F.ceil(F.col("count") / (cap / 2)))).withColumn(
            "_salts", F.ceil(F.col("_all") / SALT_ROWS)).drop("count", "_all")
        split = frame.join(big, "shard")
        first = Window.partitionBy("shard").orderBy(F.xxhash64("node"), "node")
        sample = split.where(F.col("kind") == HOME).withColumn("_r", F.row_number().over(first)).where(
            F.col("_r") <= FANOUT * SAMPLE_PER_CHILD)

        def centres(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_r")
            c = kmeans(unit(pdf["vec"]), int(pdf["_k"].iloc[0]))
            return pd.DataFrame({"shard": pdf["shard"].iloc[0], "child": range(len(c)), "centre": list(c),
                                 "_salts": pdf["_salts"].iloc[0]})

        fitted = sample.select("shard", "vec", "_r", "_k", "_salts").groupBy("shard").applyInPandas(
            centres, "shard string, child int, centre array<double>, _salts long")
        fitted = fitted.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)))

        def assign(key, pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            if pdf.empty or found.empty:
                return pdf[columns]
            found = found.sort_values("child")
            row, child, kind = children(unit(pdf["vec"]), pdf["kind"].to_numpy(), np.array(found["centre"].tolist()), overlap, reach)
            out = pdf.iloc[row]
            return out.assign(shard=[f"{s}/{c}" for s, c in zip(out["shard"], child)], kind=kind)[columns]

        salted = split.withColumn("_salt", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("_salts")))
        moved = salted.groupBy("shard", "_salt").cogroup(fitted.groupBy("shard", "_salt")).applyInPandas(assign, frame.schema)
        frame = pinned(frame.join(big, "shard", "left_anti").select(*columns).unionAll(moved))
    return frame


def prune(x: np.ndarray, i: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of rows of candidates (-1: none) by chords, nearest first; at most ``degree`` stay in each row.

    Chords are compared by their squares, and those between candidates only for the one that is kept.
    """
    c = np.maximum(candidates, 0)
    square = lambda cosine: np.maximum(2 - 2 * cosine, 0)
    near = x[c]
    to_i, between = square((near @ x[i][:, :, None])[:, :, 0]), near @ near.transpose(0, 2, 1)
    alive = (candidates >= 0) & (candidates != i[:, None])
    to_i = np.where(alive, to_i, np.inf)
    out, rows = np.full((len(i), degree), -1), np.arange(len(i))
    for t in range(degree):
        if not alive.any():
            break
        best = np.where(alive, to_i, np.inf).argmin(1)
        has = alive[rows, best]
        out[has, t] = candidates[rows, best][has]
        alive &= alpha * alpha * square(between[rows, best]) > to_i
        alive[rows, best] = False
    return out


def flat_graph(x: np.ndarray, degree: int, alpha: float, width: int = 96, block: int = 256) -> np.ndarray:
    """Neighbours of each row (-1: none): pruned nearest ones, then pruned again with those that name the row.

    Single precision is enough to choose edges; what is linked is decided on all digits.
    """
    x = x.astype(np.float32)
    n = len(x)
    k = min(width, n - 1)
    out = np.full((n, degree), -1)
    if k < 1:
        return out
    for at in range(0, n, block):
        i = np.arange(at, min(at + block, n))
        near = x[i] @ x.T
        near[np.arange(len(i)), i] = -np.inf
        out[i] = prune(x, i, np.argpartition(-near, k - 1, axis=1)[:, :k], degree, alpha)
    source, target = np.repeat(np.arange(n), degree), out.reshape(-1)
    source, target = source[target >= 0], target[target >= 0]
    # Of those that name a row, the nearest ``degree``.
    order = np.lexsort((-np.einsum("ed,ed->e", x[source], x[target]), target))
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    back = np.full((n, degree), -1)
    back[target[place < degree], place[place < degree]] = source[place < degree]
    both = np.concatenate([out, back], axis=1)
    both.sort(axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    for at in range(0, n, block):
        i = np.arange(at, min(at + block, n))
        out[i] = prune(x, i, both[i], degree, alpha)
    return out


def open_nodes(opened: np.ndarray, graph: np.ndarray, n: int, block: int = 256) -> np.ndarray:
    """Which nodes (columns) neighbour a node opened in each row."""
    reached = np.zeros(opened.shape, bool)
    used = np.flatnonzero(opened.any(0))
    for at in range(0, len(used), block):
        nodes = used[at:at + block]
        edges = np.zeros((len(nodes), n + 1), np.float32)
        edges[np.arange(len(nodes))[:, None], graph[nodes]] = 1  # -1 falls on the last column
        reached |= (opened[:, nodes].astype(np.float32) @ edges[:, :n]) > 0
    return reached


def in_range(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, starts: np.ndarray, threshold: float, slack: float,
             beam: int, steps: int) -> np.ndarray:
    """Nodes (columns) within the threshold of each query, as found over the graph."""
    n, rows = len(x), np.arange(len(queries))
    cosine = np.full((len(queries), n), -np.inf)
    opened = np.zeros(cosine.shape, bool)

    def look(new: np.ndarray) -> None:
        columns = np.flatnonzero(new.any(0))
        cosine[:, columns] = np.where(new[:, columns], x[queries] @ x[columns].T, cosine[:, columns])

    seen = np.zeros(cosine.shape, bool)
    seen[:, starts] = True
    seen[rows, queries] = True  # a query is a node of the graph itself
    look(seen)
    going, width, k = rows, graph.shape[1], min(beam, n)
    top = np.partition(cosine, n - k, axis=1)[:, n - k:]  # the best cosines of each query so far
    for _ in range(steps):
        shut = np.where(opened[going], -np.inf, cosine[going])
        best = shut.argmax(1)
        value = shut[np.arange(len(going)), best]
        go = np.isfinite(value) & (value >= top[going].min(1))
        going, best = going[go], best[go]
        if not len(going):
            break
        opened[going, best] = True
        # One node for each query: its few neighbours are looked at one by one.
        edges = graph[best]
        row, place = np.nonzero((edges >= 0) & ~seen[going[:, None], edges])
        query, edge = going[row], edges[row, place]
        seen[query, edge] = True
        cosine[query, edge] = np.einsum("ed,ed->e", x[queries[query]], x[edge])
        more = np.full(edges.shape, -np.inf)
        more[row, place] = cosine[query, edge]
        top[going] = np.partition(np.concatenate([top[going], more], axis=1), width, axis=1)[:, width:]
    while True:
        now = (cosine >= threshold - slack) & ~opened
        if not now.any():
            return cosine >= threshold
        opened |= now
        new = open_nodes(now, graph, n) & ~seen
        seen |= new
        look(new)


def search(pdf: pd.DataFrame, threshold: float, slack: float, beam: int, steps: int, recall: float,
           block: int = 128) -> pd.DataFrame:
    """Links of one shard: a row for each home node, and for each other node that is linked."""
    pdf = pdf.sort_values("node")
    x, node, weight = unit(pdf["vec"]), pdf["node"].to_numpy(), pdf["n"].to_numpy()
    n = len(x)
    lists = [np.asarray(v, np.int64) for v in pdf["near"]]
    graph = np.full((n, max([1, *map(len, lists)])), -1)
    for i, v in enumerate(lists):
        at = np.minimum(np.searchsorted(node, v), n - 1)
        at = at[node[at] == v]  # neighbours in other shards only are not reached from here
        graph[i, :len(at)] = at
    starts = [int((x @ x.mean(0)).argmax())]
    for _ in range(3):  # the medoid, and nodes far from all entries so far
        starts.append(int((x @ x[starts].T).max(1).argmin()))
    home, audited = pdf["kind"].to_numpy() == HOME, pdf["audited"].to_numpy()
    queries = np.flatnonzero(home)
    block = max(1, min(block, BLOCK_CELLS // n))
    links, part = np.zeros(n, np.int64), np.arange(n)
    true, found = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def visit(hits: np.ndarray, q: np.ndarray) -> None:
        links[q] = hits @ weight - 1
        for i, row in zip(q, hits):
            parts = np.unique(part[row])
            if len(parts) > 1:
                part[np.isin(part, parts)] = parts[0]

    for at in range(0, len(queries), block):
        q = queries[at:at + block]
        hits = in_range(x, graph, q, np.array(starts), threshold, slack, beam, steps)
        hits[np.arange(len(q)), q] = True
        visit(hits, q)
        check = audited[q]
        exact = x[q[check]] @ x.T >= threshold
        exact[np.arange(check.sum()), q[check]] = True
        true[q[check]] = exact.sum(1) - 1
        found[q[check]] = (exact & hits[check]).sum(1) - 1
    if found.sum() < recall * true.sum():
        for at in range(0, len(queries), block):
            q = queries[at:at + block]
            hits = x[q] @ x.T >= threshold
            hits[np.arange(len(q)), q] = True
            visit(hits, q)
    keep = home | (part != np.arange(n))
    return pd.DataFrame({"node": node, "links": np.where(home, links, -1), "part": node[part], "audited_true": true,
                         "audited_found": found})[keep]


def visit_blocks(frame: DataFrame, size: int = VISIT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Home and visiting rows of each shard, dealt to blocks of about ``size``: every two meet in a group (shard, _h, _v)."""
    count = pinned(frame.groupBy("shard").agg(*[F.ceil(F.count_if(F.col("kind") == k) / size).alias(c) for k, c in (
        (HOME, "_hs"), (VISIT, "_vs"))]).where("_hs > 0 and _vs > 0"))
    dealt = frame.join(count, "shard")
    salt = lambda n: F.pmod(F.xxhash64(F.lit(2), "node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ("shard", "node", "n", "audited", "vec")
    return (dealt.where(F.col("kind") == HOME).select(*columns, salt("_hs").alias("_h"), every("_vs").alias("_v")),
            dealt.where(F.col("kind") == VISIT).select(*columns, salt("_vs").alias("_v"), every("_hs").alias("_h")).toDF(
                *columns, "_v", "_h"))


def meet(home: pd.DataFrame, visit: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of a block of homes with a block of visitors: a row for each home node, and for each visitor that is linked."""
    names = ["node", "links", "part", "audited_true", "audited_found"]
    if home.empty or visit.empty:
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in names})
    x, y, weight = unit(home["vec"]), unit(visit["vec"]), visit["n"].to_numpy()
    node = np.concatenate([home["node"], visit["node"]])
    order = np.argsort(node, kind="stable")
    place = np.empty_like(order)  # rows in order of nodes, so a part's least row is its least node
    place[order] = np.arange(len(order))
    part, links, true = np.arange(len(node)), np.zeros(len(home), np.int64), np.zeros(len(home), np.int64)
    step = max(1, BLOCK_CELLS // len(y))
    for at in range(0, len(x), step):
        hits = x[at:at + step] @ y.T >= threshold
        links[at:at + step], true[at:at + step] = hits @ weight, hits.sum(1)
        i, j = np.nonzero(hits)
        part = merged(part, place[i + at], place[j + len(x)])
    least = node[order][part[place]]
    true = np.where(home["audited"], true, 0)
    pad = lambda a, fill: np.concatenate([a, np.full(len(y), fill)])
    keep = (least != node) | (np.arange(len(node)) < len(x))
    return pd.DataFrame(dict(zip(names, (node, pad(links, -1), least, pad(true, 0), pad(true, 0)))))[keep]


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, cap: int = 1500, overlap: int = 3, degree: int = 32,
                    alpha: float = 1.3, beam: int = 8, steps: int = 24, slack: float = 0.05, recall: float = 0.95,
                    audit_every: int = 50) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_true, audited_found) of every vector; see the module's text."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fit = F.coalesce(F.col("label").isNotNull() & finite & F.exists("vec", lambda v: v != 0), F.lit(False))
    # Norms must not overflow or vanish: numbers this large or small are scaled by the largest first.
    top = F.array_max(F.transform("vec", F.abs))
    extreme = (top > 1e100) | (top < 1e-100)
    rows = rows.withColumn("vec", F.when(fit & extreme, F.transform("vec", lambda v: v / top)).when(fit, F.col("vec")))
    rows = rows.withColumn("key", F.when(fit, F.xxhash64("label", "vec")))
    nodes = rows.where("key is not null").groupBy("key", "label", "vec").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("n"),
        F.coalesce(F.max((F.col("vec_id") % audit_every == 0)), F.lit(False)).alias("audited"))
    nodes = pinned(nodes.withColumn("node", F.monotonically_increasing_id()))
    frame = shards(nodes, cap, overlap, float(np.sqrt(2 - 2 * threshold)))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        node = pdf["node"].to_numpy()
        near = flat_graph(unit(pdf["vec"]), degree, alpha)
        return pd.DataFrame({"node": node, "near": [node[g[g >= 0]] for g in near]})

    adjacency = frame.where(F.col("kind") != VISIT).groupBy("shard").applyInPandas(build, "node long, near array<long>")
    adjacency = adjacency.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    schema = "node long, links long, part long, audited_true long, audited_found long"
    found = frame.where(F.col("kind") != VISIT).join(adjacency, "node").groupBy("shard").applyInPandas(
        lambda pdf: search(pdf, threshold, slack, beam, steps, recall), schema)
    home, visit = visit_blocks(frame)
    met = home.groupBy("shard", "_h", "_v").cogroup(visit.groupBy("shard", "_h", "_v")).applyInPandas(
        lambda a, b: meet(a, b, threshold), schema)
    found = pinned(found.unionAll(met))
    roots = components(found.select(F.col("node").alias("a"), F.col("part").alias("b")))
    counted = found.where("links >= 0").groupBy("node").agg(*[F.sum(c).alias(c) for c in ("links", "audited_true", "audited_found")])
    named = nodes.select("key", "label", "vec", "node", "first").join(counted, "node", "left").join(roots, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    named = named.join(least, "root").select("key", *[F.col(c).alias(f"_{c}") for c in ("label", "vec")], "links", "component",
                                             "audited_true", "audited_found")
    same = (rows["key"] == named["key"]) & (rows["label"] == named["_label"]) & (rows["vec"] == named["_vec"])
    out = rows.join(named, same, "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), "audited_true", "audited_found")


def op10_embedding_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op10_embedding_dedup": op10_embedding_dedup}
