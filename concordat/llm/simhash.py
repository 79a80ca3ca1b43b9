"""Operator 1, SimHash near-duplicates by the generalised pigeonhole principle.

64-bit fingerprints of word shingles; two documents are linked if their
fingerprints differ in at most ``radius`` bits, and components of links are
near-duplicate groups.

Candidate search: the 64 bits are split into m groups of correlated bits, and
group i gets a threshold t_i >= -1 with sum(t) = radius - m + 1. If all groups
differed in more than t_i bits, the sum would exceed the radius, so a pair
within the radius meets its threshold in some group (a group at -1 is never
probed). Thresholds come from a dynamic program over estimated candidate
counts, with the estimate taken from the co-occurrence counts of all bits over
all fingerprints. Candidates are verified on all 64 bits.

Documents with one fingerprint are one node from the start, so groups of exact
copies cost nothing. A signature with more than ``hot`` fingerprints is not
joined pair by pair: its fingerprints, and those that probe it, link through
their one-bit neighbours instead - two words within 2 bits share such a
neighbour - which is linear in their number and just as exact.

Edge cases: null and empty texts have no words and fingerprint zero, linked
like any other; a text of fewer words than a shingle is one shingle; repeated
rows and null ids get their text's group; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.llm.common import documents, fresh, map_texts, pinned
from concordat.llm.links import between_roots, components, extended, merged

BITS, SEED, CHUNK = 64, 42, 1 << 16


def fingerprint(text: bytes, shingle: int) -> int:
    """Bit k is set if it is set in over half of the shingles' XXH64 (A-Z lower-cased, ASCII white space apart)."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at:at + CHUNK + shingle - 1] if n > 1 else words
        grams = zip(*(part[i:] for i in range(shingle))) if n > 1 else [part]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    return map_texts(docs, "fp long", lambda texts: {
        "fp": pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))})


def bit_counts(fps: DataFrame) -> np.ndarray:
    """The 64 x 64 table of how often two bits are set together, over all fingerprints."""
    def count(batches):
        total = np.zeros((BITS, BITS))
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            for at in range(0, len(raw), CHUNK):
                bits = np.unpackbits(raw[at:at + CHUNK], axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
        rows = total.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS), pa.int32()), *(pa.array(c) for c in rows.T)],
                                         names=["bit", *(f"c{j}" for j in range(BITS))])

    schema = "bit int, " + ", ".join(f"c{j} long" for j in range(BITS))
    rows = fps.select("fp").mapInArrow(count, schema).groupBy("bit").agg(*[F.sum(f"c{j}") for j in range(BITS)]).collect()
    table = np.zeros((BITS, BITS))
    for row in rows:
        table[row[0]] = row[1:]
    return table


def _groups(corr: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near-equal size; each grows by the free bit most correlated with it."""
    free, out = set(range(BITS)), []
    for size in (BITS // m + (i < BITS % m) for i in range(m)):
        group = [max(sorted(free), key=lambda b: corr[b, list(free)].sum())]
        free.remove(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: corr[b, group].sum())
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def _within(group: list[int], p: np.ndarray, pair: np.ndarray, corr: np.ndarray, radius: int) -> np.ndarray:
    """Chance that two random fingerprints differ in at most t bits of the group, for t in 0..radius.

    Bits depend on each other along a maximum spanning tree of their
    correlations; ``pair[j, k]`` is the chance that both bits agree.
    """
    root, rest, tree = group[0], set(group[1:]), []
    reach = {b: root for b in rest}
    while rest:
        b = max(sorted(rest), key=lambda x: corr[x, reach[x]])
        rest.remove(b)
        tree.append((reach[b], b))
        for x in rest:
            if corr[x, b] > corr[x, reach[x]]:
                reach[x] = b
    agree = p * p + (1 - p) ** 2
    state = {b: np.zeros((2, radius + 1)) for b in group}  # [differs][bits that differ in the subtree]
    for b in group:
        state[b][0, 0] = 1
        state[b][1, 1 if radius else 0] = 1 if radius else 0
    for up, b in reversed(tree):
        both = min(pair[up, b], agree[up], agree[b])
        table = np.array([[both, agree[up] - both], [agree[b] - both, max(0.0, 1 - agree[up] - agree[b] + both)]])
        table /= np.maximum(table.sum(1, keepdims=True), 1e-12)
        for s in (0, 1):
            below = table[s] @ state[b]
            state[up][s] = np.convolve(state[up][s], below)[:radius + 1]
    return np.cumsum(agree[root] * state[root][0] + (1 - agree[root]) * state[root][1])


def plan(counts: np.ndarray, n: int, radius: int, parts: tuple[int, ...] = (1, 2, 3, 4),
         row_cost: float = 4.0) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each probed group: the cheapest allocation over all numbers of groups in ``parts``.

    The cost of a threshold is the signatures it writes, ``row_cost`` each,
    plus the candidates it is expected to bring; ``counts`` and ``n`` cover all
    fingerprints.
    """
    n = max(n, 1)  # without fingerprints every cost would be 0, and the first allocation the cheapest
    p = np.diag(counts) / n
    both = counts / n
    one = p[:, None] - both
    other = p[None, :] - both
    none = 1 - both - one - other
    pair = both ** 2 + one ** 2 + other ** 2 + none ** 2
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both - np.outer(p, p)) / np.outer(spread, spread)
    best: tuple[float, list] = (float("inf"), [])
    for m in parts:
        groups = _groups(corr, m)
        chance = [_within(g, p, pair, corr, radius) for g in groups]
        # least[s]: the cheapest way to give the groups so far thresholds with sum s
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g, c in zip(groups, chance):
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (cost, chosen) in least.items():
                for t in range(-1, radius + 1):
                    keys = sum(comb(len(g), k) for k in range(t + 1))
                    more = cost + (0 if t < 0 else n * (keys + (t > 0)) * row_cost + n * n * c[t] / 2)
                    if s + t not in step or more < step[s + t][0]:
                        step[s + t] = (more, [*chosen, t])
            least = step
        cost, chosen = least.get(radius - m + 1, (float("inf"), []))
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, chosen) if t >= 0])
    return best[1]


def _signatures(fps: DataFrame, groups: list[tuple[list[int], int]], probe: bool, *keep: str) -> DataFrame:
    """(part, key, fp): the fingerprint's bits in each group; for probes, also with up to t of them flipped."""
    rows = []
    for i, (bits, t) in enumerate(groups):
        mask = sum(1 << b for b in bits)
        mask -= (mask >> 63) << 64
        flips = [0]
        for k in range(1, t + 1 if probe else 1):
            flips += [sum(1 << b for b in c) for c in combinations(bits, k)]
        flips = [f - ((f >> 63) << 64) for f in flips]
        key = F.col("fp").bitwiseAND(F.lit(mask))
        keys = F.transform(F.array(*[F.lit(f) for f in flips]), lambda f: key.bitwiseXOR(f))
        rows.append(F.transform(keys, lambda x, i=i: F.struct(F.lit(i).alias("part"), x.alias("key"))))
    return fps.select("fp", *keep, F.explode(F.concat(*rows)).alias("_k")).select("_k.part", "_k.key", "fp", *keep)


def _far(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, radius: int = 2, hot: int = 256) -> DataFrame:
    """(a, b): links between different fingerprints of ``fps`` (fp, pinned and distinct) that connect all
    pairs within ``radius`` <= 2 bits; every row is a verified pair."""
    groups = plan(bit_counts(fps), fps.count(), radius)
    index, probes = _signatures(fps, groups, False), _signatures(fps, groups, True)
    busy = pinned(index.groupBy("part", "key").count().where(F.col("count") > hot).select("part", "key"))
    star = None
    if not busy.isEmpty():
        star = probes.join(busy, ["part", "key"], "left_semi").unionAll(
            index.join(busy, ["part", "key"], "left_semi")).select("fp").distinct()
        index, probes = (x.join(busy, ["part", "key"], "left_anti") for x in (index, probes))
    left, right = index.withColumnRenamed("fp", "a"), probes.withColumnRenamed("fp", "b")
    found = left.join(right, ["part", "key"]).where((F.col("b") < F.col("a")) & (_far(F.col("a"), F.col("b")) <= radius))
    found = found.select("a", "b")
    if star is not None:
        found = found.unionAll(_through_neighbours(star, radius))
    return found


def _through_neighbours(fps: DataFrame, radius: int) -> DataFrame:
    """Links among ``fps`` by their one-bit neighbours: for radius 1 those that are fingerprints themselves; for
    radius 2 each fingerprint and the least one with a neighbour in common, which connects all that share it."""
    flips = [0] * (radius > 1) + [(1 << b) - ((1 << b >> 63) << 64) for b in range(BITS)] * (radius > 0)
    near = fps.select("fp", F.explode(F.transform(F.array(*[F.lit(f).cast("long") for f in flips]),
                                                  lambda f: F.col("fp").bitwiseXOR(f))).alias("key"))
    if radius < 2:
        return near.join(fps.select(F.col("fp").alias("key")), "key").select(F.col("fp").alias("a"), F.col("key").alias("b"))
    least = near.groupBy("key").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    return near.join(least, "key").select(F.col("fp").alias("a"), "b").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, hot: int = 256) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; see the module's text."""
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    docs_fp = pinned(fingerprints(docs, shingle))
    nodes = pinned(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes.select("fp"), radius, hot)).withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = named.groupBy("root").agg(F.min("first").alias("component_id"))
    group = named.select("fp", "root").join(first, "root").select("fp", "component_id")
    return docs_fp.join(group, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- Groups by similarity --------------------------------------------------

_POPCOUNT = np.bitwise_count


#: Rows of a block, about: a bucket with more is dealt to several.
BUCKET = 4096

#: Bits of the wide fingerprint, and how many may differ. Two texts of similarity s differ in about WIDE * arccos(c) / pi bits
#: with c = 2s / (1 + s), the share of shingles both have: for s = 0.8 that is 19, and 40 lies five standard deviations above;
#: texts without a shingle in common differ in 64.
WIDE, WIDE_REACH = 128, 40

#: What a bound on sizes gives way for rounding.
SLACK = 1e-9

#: Rounds of some pairs, at most, before all that are left between groups pass the exact filter.
ROUNDS = 3


def _within_radius(fps: np.ndarray, label: np.ndarray, radius: int, nearest: int, side: np.ndarray | None,
                   wide: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of rows of different labels within ``radius``, and which are among an end's ``nearest``.
    With ``side`` only pairs across sides 0 and 1, with ``wide`` only those whose wide fingerprints are close."""
    left, right = (np.arange(len(fps)),) * 2 if side is None else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    found = []
    for at in range(0, len(left), 512):  # some rows against all: the table of distances stays small
        here = left[at:at + 512]
        far = _POPCOUNT(fps[here, None] ^ fps[None, right])
        near = (far <= radius) & (label[here, None] != label[None, right])
        if side is None:
            near &= here[:, None] > right
        i, j = np.nonzero(near)
        if wide is not None:
            close = _POPCOUNT(wide[here[i]] ^ wide[right[j]]).sum(1, dtype=np.int64) <= WIDE_REACH
            i, j = i[close], j[close]
        found.append((i + at, j, far[i, j]))
    i, j, far = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    end, d = np.concatenate([left[i], right[j]]), np.tile(far, 2)
    order = np.lexsort((d, end))
    rank = np.empty(len(end), np.int64)
    rank[order] = np.arange(len(end)) - np.searchsorted(end[order], end[order])
    return left[i], right[j], (rank < nearest).reshape(2, -1).any(0)


def choose(fps: np.ndarray, label: np.ndarray, radius: int, nearest: int = 4, side: np.ndarray | None = None,
           wide: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, rest): pairs of rows within ``radius`` that connect all such pairs between labels, each row's ``nearest``
    among them, and the rows that have pairs beyond those."""
    label = np.unique(label, return_inverse=True)[1]
    left, right, rest = [], [], None
    while True:
        i, j, pick = _within_radius(fps, label, radius, nearest, side, wide)
        left.append(i[pick])
        right.append(j[pick])
        rest = np.unique(np.concatenate([i[~pick], j[~pick]])) if rest is None else rest
        if pick.all():
            return np.concatenate(left), np.concatenate(right), rest
        label, nearest = merged(label, left[-1], right[-1]), 1


def spanning(nodes: np.ndarray, fps: np.ndarray, radius: int, nearest: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within ``radius`` that connect all such pairs of one bucket, a node's ``nearest`` among them."""
    i, j, _ = choose(fps, np.arange(len(fps)), radius, nearest)
    return nodes[i], nodes[j]


def _block_pairs(rows: DataFrame, radius: int, nearest: int) -> DataFrame:
    """(a, b, far) chosen in every block of ``rows`` (part, key, block, side, node, fp, w0, w1, label) between different labels,
    with the bits they differ in; (a, a) for a node that has pairs beyond those. Side 0 meets side 1; side 2 meets itself."""
    names = ("part", "key", "block", "side", "node", "fp", "w0", "w1", "label")

    def run(batches):
        kept: list[tuple[np.ndarray, ...]] = []  # rows of the block that the last batch ended in

        def pairs(rows: list[tuple[np.ndarray, ...]]):
            side, node, fp, w0, w1, label = (np.concatenate(c) for c in list(zip(*rows))[3:])
            i, j, rest = choose(fp.view(np.uint64), label, radius, nearest, None if (side == 2).any() else side,
                                np.stack([w0, w1], 1).view(np.uint64))
            far = _POPCOUNT(fp[i].view(np.uint64) ^ fp[j].view(np.uint64)).astype(np.int32)
            return np.concatenate([node[i], node[rest]]), np.concatenate([node[j], node[rest]]), np.concatenate([far, np.zeros(len(rest), np.int32)])

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b", "far"])

        for batch in batches:
            columns = [batch.column(n).to_numpy() for n in names]
            here = columns[:3]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in here], axis=0)) + 1
            found = []
            for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(here[0])]])):
                if a == b:
                    continue
                if kept and any(k[0] != c[a] for k, c in zip(kept[0], here)):
                    if sum(len(k[0]) for k in kept) > 1:
                        found.append(pairs(kept))
                    kept = []
                kept.append(tuple(c[a:b] for c in columns))
            if found:
                yield batch_of(found)
        if kept:
            yield batch_of([pairs(kept)])

    ordered = rows.select(*names).repartition("part", "key", "block").sortWithinPartitions("part", "key", "block")
    return ordered.mapInArrow(run, "a long, b long, far int")


def _dealt(keys: DataFrame, large: DataFrame, seed: int) -> DataFrame:
    """Rows for ``_block_pairs`` that look at a bucket as a whole, or at each of its parts by a seeded salt."""
    salt = F.pmod(F.xxhash64(F.lit(seed), "node"), F.coalesce("salts", F.lit(1).cast("long")))
    return keys.join(F.broadcast(large), ["part", "key"], "left").select(
        "part", "key", salt.alias("block"), F.lit(2).alias("side"), "node", "fp", "w0", "w1", "label")


def _all_blocks(keys: DataFrame, size: int) -> DataFrame:
    """Rows for ``_block_pairs`` that bring together every two nodes of a bucket whose labels differ.

    A label of more than ``size`` nodes has blocks of its own, which never
    meet each other; all other labels share blocks.
    """
    at = ["part", "key"]
    count = pinned(keys.groupBy(*at, "label").agg(F.count("*").alias("n")))
    several = count.groupBy(*at).agg(F.sum(F.when(F.col("n") <= size, F.col("n"))).alias("small"), F.count("*").alias("labels"))
    own = F.when(F.col("n") > size, F.col("label"))
    salts = F.ceil(F.when(F.col("n") > size, F.col("n")).otherwise(F.col("small")) / size)
    dealt = pinned(count.join(several.where("labels > 1"), at).select(*at, "label", own.alias("own"), salts.alias("salts")))
    block = lambda salt: F.xxhash64(F.col("own").isNull(), "own", salt)
    there = dealt.select(*at, "own", "salts").distinct().select(
        *at, "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    there = there.select(*at, F.col("own").alias("o"), block(F.col("salt")).alias("x"))
    meet = there.join(there.select(*at, F.col("o").alias("p"), F.col("x").alias("y")), at).where(
        (F.col("x") <= F.col("y")) & ~F.coalesce(F.col("o") == F.col("p"), F.lit(False)))
    meet = pinned(meet.select(*at, "x", "y", F.xxhash64("x", "y").alias("block")))
    salt = F.pmod(F.xxhash64(F.lit(5), "node"), F.col("salts"))
    rows = keys.join(dealt, [*at, "label"]).withColumn("_b", block(salt))
    out = []
    for side, end in ((0, meet.withColumnRenamed("x", "_b")), (1, meet.where("x < y").withColumnRenamed("y", "_b"))):
        what = F.when(F.col("_b") == F.col("y"), 2).otherwise(0) if side == 0 else F.lit(1)
        out.append(rows.join(end, [*at, "_b"]).select(*at, "block", what.alias("side"), *[c for c in keys.columns if c not in at]))
    return out[0].unionAll(out[1])


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes): the shingle sets of the nodes in ``wanted``."""
    wanted = wanted.select("node").distinct().join(nodes, "node").select("node", F.col("first").alias("doc_id"))
    sets = map_texts(docs.select("doc_id", "text").join(wanted, "doc_id"), "hashes array<long>, own long", lambda texts: {
        "hashes": pa.array([shingle_hashes(t, shingle) for t in texts], pa.list_(pa.int64())), "own": sequence_hashes(texts)},
        keep=("node",))
    # An id that several texts have brings them all; the node's own is the one wanted.
    return sets.where("own = node").groupBy("node").agg(F.min("hashes").alias("hashes"))


def _of_similarity(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose ``sets`` (node, hashes) have the similarity."""
    a = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    b = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    same = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(a, "a").join(b, "b").where(same >= similarity * (F.size("ha") + F.size("hb") - same)).select("a", "b")


def _similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts have the similarity, by their shingle sets."""
    sets = _sets(docs, nodes, pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")), shingle)
    return _of_similarity(sets, pairs, similarity)


def _prefix(share: float) -> Column:
    """How many first shingles of a set of ``size`` hold one of any ``share`` of it."""
    return F.col("size") - F.ceil(F.col("size") * share - SLACK) + 1


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(node, fp, size, token, at): the first shingles of each of ``sets`` (node, fp, hashes), ordered by how many sets have
    them, and their places; but for those that one set has alone. Two sets of that similarity share one, the smaller
    set's within a shorter prefix (``_met``)."""
    token = sets.select("node", F.explode("hashes").alias("token"))
    common = token.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    shared = token.join(common, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("shared"))
    rows = sets.select("node", "fp", F.size("hashes").alias("size")).join(shared, "node")
    rows = rows.withColumn("alone", F.col("size") - F.size("shared"))  # those come first
    rows = rows.withColumn("shared", F.slice("shared", 1, F.greatest(_prefix(similarity) - F.col("alone"), F.lit(0)).cast("int")))
    rows = rows.select("node", "fp", "size", "alone", F.posexplode("shared").alias("at", "s"))
    return rows.select("node", "fp", "size", F.col("s.token").alias("token"), (F.col("alone") + F.col("at")).alias("at"))


def _met(pairs: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Those of ``pairs`` of prefix rows, with _a and _b after their columns' names, that may have the similarity: the
    first is the smaller set, and enough shingles are left behind both places."""
    left = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    return pairs.where(
        (F.col("label_a") != F.col("label_b")) & (F.struct("size_a", "node_a") < F.struct("size_b", "node_b"))
        & (F.col("size_a") >= similarity * F.col("size_b") - SLACK) & (_far(F.col("fp_a"), F.col("fp_b")) <= radius)
        & (left >= similarity / (1 + similarity) * (F.col("size_a") + F.col("size_b")) - SLACK))


def _tried(rows: DataFrame, similarity: float, radius: int, seed: int, nearest: int, spread: int = BUCKET) -> DataFrame:
    """(a, b): some pairs of different labels that may have the similarity, a few for each label, by the seed.

    Rows of a shingle (of a part of it, if it has more than ``spread``) stand in a row by a
    seeded hash and meet the next two, so there are no more pairs than twice the rows.
    """
    count = rows.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > spread)
    salted = rows.join(count.select("token", F.ceil(F.col("n") / spread).alias("salts")), "token", "left").withColumn(
        "salt", F.pmod(F.xxhash64(F.lit(seed), "node"), F.coalesce("salts", F.lit(1).cast("long"))))
    names = ("node", "fp", "label", "size", "at")
    line = Window.partitionBy("token", "salt").orderBy(F.xxhash64(F.lit(seed), F.lit("place"), "node"), "node")
    me = F.struct(*names)
    seen = salted.select("token", "salt", *names, F.array(F.lead(me, 1).over(line), F.lead(me, 2).over(line)).alias("next"))
    seen = seen.select(me.alias("x"), F.explode(F.array_compact("next")).alias("y"))
    turned = F.struct("x.size", "x.node") > F.struct("y.size", "y.node")
    pairs = seen.select(*[F.when(turned, F.col(f"{p}.{c}")).otherwise(F.col(f"{q}.{c}")).alias(f"{c}_{end}")
                          for p, q, end in (("y", "x", "a"), ("x", "y", "b")) for c in names])
    met = _met(pairs, similarity, radius).select(
        F.col("label_a").alias("l"), F.col("label_b").alias("m"), F.col("node_a").alias("a"), F.col("node_b").alias("b"),
        F.xxhash64(F.lit(seed), "node_a", "node_b").alias("far")).distinct()
    return _nearest(met, ("l", "m"), nearest)


def _may_be_similar(sets: DataFrame, similarity: float, radius: int, spread: int = BUCKET, prefixes: DataFrame | None = None) -> DataFrame:
    """(a, b): pairs of ``sets`` (node, fp, label, hashes) with different labels and fingerprints within ``radius``, but for
    those that an exact filter shows to lie below the similarity; ``prefixes`` are theirs, if made already.

    Shingles that one label has alone are left out, and rows of a shingle's main
    label meet only those of others, so large groups that are one already cost
    nothing; a shingle with more than ``spread`` rows is salted.
    """
    rows = pinned(_prefixes(sets, similarity)) if prefixes is None else prefixes
    rows = rows.join(sets.select("node", "label"), "node")
    by_label = rows.groupBy("token", "label").agg(F.count("*").alias("n"))
    several = by_label.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("main"))
    several = several.where("labels > 1").select("token", "main", F.ceil(F.col("n") / spread).alias("salts"))
    rows = pinned(rows.join(several, "token").select(
        "node", "fp", "label", "size", "token", "at", "salts", (F.col("label") == F.col("main")).alias("usual")))
    smaller = rows.where(F.col("at") < _prefix(2 * similarity / (1 + similarity))).withColumn(
        "salt", F.pmod(F.xxhash64(F.lit(7), "node"), "salts"))
    larger = rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    here = smaller.select("token", "salt", *[F.col(c).alias(f"{c}_a") for c in ("node", "fp", "label", "size", "at", "usual")])
    there = larger.select("token", "salt", *[F.col(c).alias(f"{c}_b") for c in ("node", "fp", "label", "size", "at", "usual")])
    met = here.where("not usual_a").join(there, ["token", "salt"]).unionByName(
        here.where("usual_a").join(there.where("not usual_b"), ["token", "salt"]))
    return _met(met, similarity, radius).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    """Distinct XXH64 of the word shingles, signed."""
    words = text.lower().split()
    if not words:
        return []
    grams = [words] if len(words) < shingle else zip(*(words[i:] for i in range(shingle)))
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams], np.uint64)).view(np.int64).tolist()


def wide_fingerprint(text: bytes, shingle: int) -> tuple[int, int]:
    """Two signed words whose bits are set if they are set in over half of the distinct shingles' mixed hashes."""
    hashes = np.array(shingle_hashes(text, shingle), np.int64).view(np.uint64)
    out = []
    for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        mixed = hashes * np.uint64(factor)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(factor)
        counts = np.zeros(BITS, np.int64)
        for at in range(0, len(mixed), CHUNK):
            counts += np.unpackbits(mixed[at:at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0]))
    return out[0], out[1]


def sequence_hashes(texts: list[bytes]) -> pa.Array:
    """XXH64 of each text's whole word sequence, signed."""
    return pa.array(np.array([xxhash.xxh64_intdigest(b" ".join(t.lower().split()), SEED) for t in texts],
                             np.uint64).view(np.int64))


def _nearest(pairs: DataFrame, names: tuple[str, str], nearest: int) -> DataFrame:
    """Those of ``pairs`` (a, b, far, ...) that are among the ``nearest`` of one of the ends that ``names`` gives.

    The rank is cut where the rows are, before they move, so an end with many pairs sends few.
    """
    out = []
    for mine, other in (names, names[::-1]):
        rank = F.row_number().over(Window.partitionBy(mine).orderBy("far", F.xxhash64(other), "a", "b"))
        out.append(pairs.withColumn("_n", rank).where(F.col("_n") <= nearest).select("a", "b"))
    return out[0].unionAll(out[1]).distinct()


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, search: int = 2,
                   radius: int = 10, bucket: int = BUCKET, nearest: int = 4, mixings: int = 1) -> DataFrame:
    """(doc_id, component_id) of every document: groups of texts whose ``shingle``-word sets have a Jaccard
    similarity of at least ``similarity``, connected by such pairs.

    Equal word sequences are one node (null, empty and blank texts too; a null id
    never names a group). Fingerprints of ``search``-word shingles lie closer
    together for near copies than those of longer ones; candidates within
    ``radius`` bits come from the pigeonhole groups and are verified by their
    exact similarity. A pair further apart than ``radius`` is not found. An
    empty table gives no rows; extra columns are ignored.

    First every block of ``bucket`` rows of a bucket gives a node's ``nearest``
    candidates and a tree of all; over all blocks a node's ``nearest`` are verified, and then the
    nearest pairs between groups that are still apart. Those nodes of a bucket of several
    blocks that have candidates are dealt anew ``mixings`` times, to join what is alike across
    blocks; then all its blocks meet two by two, but for those of one component.
    What is left unverified lies within components of candidates; where such a component has
    several verified ones, some more pairs are verified (``_tried``) as long as that joins groups, for ``ROUNDS``
    rounds at most; then all pairs that remain pass an exact filter (``_may_be_similar``)
    and are verified too. So every candidate is verified, shown to lie below the
    similarity, or between documents of one group.
    """
    def read(texts):
        wide = np.array([wide_fingerprint(t, shingle) for t in texts], np.int64).reshape(-1, 2)
        return {"fp": pa.array(np.array([fingerprint(t, search) for t in texts], np.uint64).view(np.int64)),
                "w0": wide[:, 0], "w1": wide[:, 1], "node": sequence_hashes(texts)}

    keyed = pinned(map_texts(docs, "fp long, w0 long, w1 long, node long", read))
    nodes = pinned(keyed.groupBy("node").agg(*[F.min(c).alias(c) for c in ("fp", "w0", "w1")], F.min("doc_id").alias("first")))
    # A signature is written, moved and sorted, a candidate only compared in an array. But a bucket that chance fills
    # must be dealt to blocks, so buckets are kept small by more signatures than those two costs ask for.
    groups = plan(bit_counts(nodes), nodes.count(), radius, tuple(range(1, radius + 2)), row_cost=20.0)
    # Probes hold each plain signature too, so one set of rows serves as index and probes.
    keys = _signatures(nodes.withColumn("label", F.col("node")), groups, True, "node", "w0", "w1", "label")
    # Large buckets are few, one for each ``bucket`` signatures at most, so signatures need not move to meet them.
    large = pinned(keys.groupBy("part", "key").count().where(F.col("count") > bucket).select(
        "part", "key", F.ceil(F.col("count") / bucket).alias("salts")))
    found = pinned(_block_pairs(_dealt(keys, large, 0), radius, nearest).distinct())
    roots = pinned(components(_similar(docs, nodes, _nearest(found.where("a <> b"), ("a", "b"), nearest), similarity, shingle)))

    def joined(pairs: DataFrame) -> DataFrame:
        """The roots after ``pairs`` are verified."""
        more = pinned(_similar(docs, nodes, pairs, similarity, shingle))
        return roots if more.isEmpty() else extended(roots, more)

    def between(pairs: DataFrame) -> DataFrame:
        """One pair, the nearest, of every two labels that ``pairs`` bring together; a label's ``nearest`` of them."""
        pairs = between_roots(pairs.where("a <> b"), roots)
        best = pairs.groupBy(F.least("l", "m").alias("l"), F.greatest("l", "m").alias("m")).agg(F.min(F.struct("far", "a", "b")).alias("p"))
        return _nearest(best.select("l", "m", "p.*"), ("l", "m"), nearest)

    labelled = lambda: nodes.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    met, crowded = [found], not large.isEmpty()
    crowd = pinned(keys.drop("label").join(F.broadcast(large.drop("salts")), ["part", "key"], "left_semi"))
    for mixing in range(1, 1 + mixings * crowded):
        alike = crowd.join(found.where("a <> b").select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
        here = alike.join(labelled().select("node", "label"), "node")
        apart = here.groupBy("part", "key").agg(F.min("label").alias("m"), F.max("label").alias("n")).where("m <> n")
        more = pinned(_block_pairs(_dealt(here.join(apart, ["part", "key"], "left_semi"), large, mixing), radius, nearest).distinct())
        if more.where("a <> b").isEmpty():
            break
        met.append(more)
        roots = joined(_nearest(more.where("a <> b"), ("a", "b"), nearest))
    if crowded:
        met.append(pinned(_block_pairs(_all_blocks(crowd.join(labelled().select("node", "label"), "node"), bucket), radius, nearest).distinct()))
        roots = joined(_nearest(met[-1].where("a <> b"), ("a", "b"), nearest))
    found = reduce(DataFrame.unionAll, met)
    roots = joined(between(found))
    # All candidates lie within the components of what the blocks chose, and those of one label need no look.
    near = components(between_roots(found.where("a <> b"), roots).select(F.col("l").alias("a"), F.col("m").alias("b")))
    # A pair that was left out above has two ends with different labels still, or needs no look.
    rest = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    going = pinned(labelled().join(near.select(F.col("node").alias("label")), "label", "left_semi").join(rest, "node", "left_semi"))
    if not going.isEmpty():
        sets = pinned(_sets(docs, nodes, going, shingle).join(going.select("node", "fp"), "node"))
        rows = pinned(_prefixes(sets, similarity))
        # Two large groups that are one would give all pairs between them, so some are tried first.
        for seed in range(ROUNDS):
            more = pinned(_of_similarity(sets, _tried(rows.join(labelled().select("node", "label"), "node"), similarity, radius, seed, nearest), similarity))
            if more.isEmpty():
                break
            roots = extended(roots, more)
        left = pinned(_may_be_similar(sets.join(labelled().select("node", "label"), "node"), similarity, radius, prefixes=rows))
        more = pinned(_of_similarity(sets, left, similarity))
        roots = roots if more.isEmpty() else extended(roots, more)
    named = labelled().withColumnRenamed("label", "root")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return keyed.join(named.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_first(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, search: int = 2, radius: int = 10) -> DataFrame:
    """``docs`` with one document of each group of similar texts: the smallest id of its component.

    Of rows that repeat such an id one stays, the first in order of text and
    source. Rows without an id can't be told apart and stay as they are.
    """
    found = similar_groups(docs, similarity, shingle, search, radius)
    rows = found.where("doc_id is not null").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("head")).where("head")
    single, several = rows.where("n = 1"), rows.where("n > 1")
    first = Window.partitionBy("doc_id").orderBy(*[F.xxhash64(c) for c in ("text", "source") if c in docs.columns])
    number = fresh(docs, "number")
    again = docs.join(several, "doc_id", "left_semi").withColumn(number, F.row_number().over(first)).where(
        F.col(number) == 1).drop(number)
    kept = docs.join(single, "doc_id", "left_semi").unionByName(again)
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def op1_simhash(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op1_simhash": op1_simhash}
