"""Operator 7, mixing sources to target weights by Sainte-Laguë apportionment.

Sources, in code point order with null last, have weights 3, 1, 2 and so on in
turn and share ``share`` times all words by weight; a target stops at
``most`` times its source's words and the excess goes to the others by weight.

The words of a source lie in seeded order of its documents and are cut into
blocks of equal length: 1024 words, or a hundredth of the source if that is less.
Blocks are the seats: sources of one block length get them by the highest
quotients target / (2 k + 1), then the shards of a source (a hash of the
document) in the same way, never beyond ``most`` times the blocks there are. A
quota of q for n blocks takes every block q // n times and q % n of them once
more, evenly spaced from a seeded start. How many words of a document are taken
is then a difference of two closed forms of its place, so no block is listed.

A document's place is a running sum in slices by hash, so a source that holds a
third of all rows is never in one task, and the result depends on rows, seed and
parameters, not on files or tasks. The driver holds one row for each source and
shard: mixing weights are a setting for each source.

Edge cases: null and empty texts have size 0 and nothing is taken; repeated rows
are taken each for themselves; an empty table gives no rows; a table without
words has targets 0; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - makes pa.compute available in the workers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import documents, pinned
from concordat.llm.ranks import with_running

WEIGHTS = (3, 1, 2)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Rows of a slice, about, in which running sums are sorted.
SLICE_ROWS = 1 << 16


def n_words(text: Column) -> Column:
    """Number of runs of characters that are not ASCII white space."""
    spaced = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return spaced.cast("long")


def targets(sizes: list[int], share: float, most: float, weights: tuple[int, ...] = WEIGHTS) -> list[float]:
    """Target of each source, in order: weights share the words; what exceeds a source's limit is shared again."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    limit = most * np.array(sizes, float)
    total = share * float(sum(sizes))
    full = np.zeros(len(sizes), bool)
    out = np.zeros(len(sizes))
    while not full.all():
        out[~full] = (total - limit[full].sum()) * w[~full] / w[~full].sum()
        over = ~full & (out > limit)
        if not over.any():
            break
        full |= over
        out[full] = limit[full]
    return out.tolist()


def sainte_lague(seats: int, claims: list[float], most: list[int]) -> list[int]:
    """``seats`` by the highest quotients claim / (2 k + 1), at most ``most`` for each; ties go to the earlier."""
    out = [0] * len(claims)
    seats = min(seats, sum(most))
    # Most seats are certain: a divisor somewhat too large gives each claim no more than it gets in the end.
    lo, hi = 0.0, 4.0 * max(sum(claims), 1.0)
    given = lambda d: [min(m, int(c / d + 0.5)) for c, m in zip(claims, most)]
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid <= 0 or sum(given(mid)) > seats:
            lo = mid
        else:
            hi = mid
            out = given(mid)
    heap = [(-c / (2 * k + 1), i) for i, (c, k, m) in enumerate(zip(claims, out, most)) if k < m]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(heap, (-claims[i] / (2 * out[i] + 1), i))
    return out


def words_taken(words: int, blocks: int, quota: int, start: int, block: int) -> int:
    """Words that a quota takes of a source's words in one shard; its last block may be short."""
    whole, rest = divmod(quota, blocks)
    last = (blocks * rest + start) // blocks - ((blocks - 1) * rest + start) // blocks
    return whole * words + (rest - last) * block + last * (words - (blocks - 1) * block)


def first_block(seed: int, source: str | None, part: int, blocks: int) -> int:
    """Seeded start of a shard's block selection."""
    name = b"\0" if source is None else source.encode("utf-8", "surrogatepass")
    return crc32(b"%d/%d/" % (seed, part) + name) % blocks


def quotas(rows: list[tuple[int, int, int]], names: list[str | None], goal: list[float], lengths: list[int], most: int,
           seed: int) -> dict[tuple[int, int], tuple[int, int, int]]:
    """{(source, shard): (blocks, quota, start)} from rows (source, shard, words): sources first, then each one's shards.

    ``lengths`` are the sources' block lengths; sources of one length share its seats.

    The last block of a shard is short; where that leaves a source further from
    its target than half a block, it gets as many seats more or fewer.
    """
    there: dict[int, dict[int, int]] = {}
    for source, part, words in rows:
        if words:
            there.setdefault(source, {})[part] = words
    order = sorted(there)
    count = {s: {p: -(-w // lengths[s]) for p, w in there[s].items()} for s in order}
    by_source: dict[int, int] = {}
    for block in sorted({lengths[s] for s in order}):
        alike = [s for s in order if lengths[s] == block]
        seats = round(sum(goal[s] for s in alike) / block)
        by_source |= zip(alike, sainte_lague(seats, [goal[s] for s in alike], [most * sum(count[s].values()) for s in alike]))
    out = {}
    for s in order:
        q, block = by_source[s], lengths[s]
        parts = list(count[s])
        start = {p: first_block(seed, names[s], p, count[s][p]) for p in parts}
        best = None
        for _ in range(20):
            shares = sainte_lague(q, [float(there[s][p]) for p in parts], [most * count[s][p] for p in parts])
            miss = goal[s] - sum(words_taken(there[s][p], count[s][p], k, start[p], block) for p, k in zip(parts, shares))
            if best is None or abs(miss) < abs(best[0]):
                best = (miss, shares)
            if abs(miss) <= block / 2:
                break
            q = max(0, q + (round(miss / block) or (1 if miss > 0 else -1)))
        out |= {(s, p): (count[s][p], k, start[p]) for p, k in zip(parts, best[1])}
    return out


def _extra(k: str) -> str:
    """How many of the first k blocks are taken once more: evenly spaced, from the seeded start."""
    return f"((({k}) * _rest + _start) div _blocks)"


def _words_before(at: str) -> Column:
    """Words of the once-more blocks before place ``at`` of a source and shard."""
    k = f"(({at}) div _block)"
    return F.expr(f"{_extra(k)} * _block + ({_extra(k + ' + 1')} - {_extra(k)}) * ({at} - {k} * _block)")


def plan(docs: DataFrame, share: float = 1.5, most: int = 2, shards: int = 16, seed: int = 11,
         block: int | None = None, carry: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document, and its place in the mix.

    ``_whole`` is how often all words are taken, ``_place`` where the document
    begins in its source and shard, ``_blocks``, ``_rest``, ``_start`` and
    ``_block`` what says which blocks are taken once more. ``carry`` adds the
    whole row of ``docs`` as ``_row``.
    """
    spark = docs.sparkSession
    row = [F.struct(*docs.columns).alias("_row")] if carry else []
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_text"), *row)
    sized = sized.withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "_text"))
    sized = sized if carry else pinned(sized)
    sized = sized.withColumn("_shard", F.pmod(F.col("_hash"), F.lit(shards)).cast("int"))
    sums = sized.groupBy("source", "_shard").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).collect()
    names = sorted({r["source"] for r in sums if r["source"] is not None}, key=lambda s: s.encode("utf-8", "surrogatepass"))
    names += [None] * any(r["source"] is None for r in sums)
    index = {s: i for i, s in enumerate(names)}
    rows = sorted((index[r["source"]], r["_shard"], r["words"]) for r in sums)
    sizes = [0] * len(names)
    for i, _, words in rows:
        sizes[i] += words
    goal = targets(sizes, share, most)
    # So small that rounding to blocks can't move a source from its target by over half a percent; each has its own,
    # so a small source does not shred the others.
    lengths = [block or max(1, min(1024, s // 100)) for s in sizes]
    table = quotas(rows, names, goal, lengths, most, seed)
    settings = [(names[i], p, i, sizes[i], float(goal[i]), lengths[i], *table.get((i, p), (1, 0, 0))) for i, p, _ in rows]
    schema = ("_source string, _p int, _index int, source_size long, target double, _block long, _blocks long, _quota long, "
              "_start long")
    fixed = spark.createDataFrame(settings, schema).withColumns({
        "_whole": F.expr("_quota div _blocks"), "_rest": F.col("_quota") % F.col("_blocks")})
    # One row for each source and shard, as many as the driver has just held.
    known = sized.join(F.broadcast(fixed), F.col("source").eqNullSafe(F.col("_source")) & (F.col("_shard") == F.col("_p")))
    slices = max(1, sum(r["rows"] for r in sums) // SLICE_ROWS)
    known = known.withColumn("_slice", F.pmod(F.shiftright("_hash", 16), F.lit(slices)))
    placed = with_running(known, ["_index", "_shard"], "_slice",
                          [F.col("_hash"), F.col("doc_id"), F.col("_text"), F.col("size")], "size", "_place")
    extra = _words_before("(_place + size)") - _words_before("_place")
    taken = F.when(F.col("size") > 0, F.col("_whole") * F.col("size") + extra).otherwise(F.lit(0))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "_whole", "_place",
                         "_blocks", "_rest", "_start", "_block", *[c for c in ("_row",) if carry])


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, shards: int = 16, seed: int = 11,
        block: int | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document; see the module's text."""
    return plan(docs, share, most, shards, seed, block).select("doc_id", "size", "source_size", "target", "taken")


def parts_taken(place: int, size: int, blocks: int, rest: int, start: int, block: int) -> list[tuple[int, int]]:
    """Ranges of a document's words that are taken once more."""
    out: list[tuple[int, int]] = []
    for k in range(place // block, -(-(place + size) // block)):
        if ((k + 1) * rest + start) // blocks > (k * rest + start) // blocks:
            a, b = max(k * block - place, 0), min((k + 1) * block - place, size)
            if out and out[-1][1] == a:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def mixed(docs: DataFrame, share: float = 1.5, most: int = 2, shards: int = 16, seed: int = 11) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken.

    All words taken once or twice are whole rows; words taken once more that
    are only a part of a document are a row with that part of its text, and
    ``n_chars`` (if there) to match. Documents without words go. The text moves
    in one shuffle, with its row.
    """
    names = docs.columns
    counted = "n_chars" in names

    def run(batches):
        for batch in batches:
            rows = batch.column("_row")
            texts = rows.field(names.index("text"))
            settings = zip(*(batch.column(n).to_pylist() for n in ("size", "_whole", "_place", "_blocks", "_rest", "_start", "_block")))
            taken, new = [], {}
            for i, (size, whole, *place) in enumerate(settings):
                taken += [i] * whole
                if parts := parts_taken(place[0], size, *place[1:]):
                    if parts != [(0, size)]:
                        text = texts[i].as_py()
                        words = [m.span() for m in WORD.finditer(text)]
                        new[len(taken)] = "\n".join(text[words[a][0]:words[b - 1][1]] for a, b in parts)
                    taken.append(i)
            out = {n: rows.field(k).take(pa.array(taken, pa.int64())) for k, n in enumerate(names)}
            if new:
                at = np.zeros(len(taken), bool)
                at[list(new)] = True
                cut = list(new.values())
                out["text"] = pa.compute.replace_with_mask(out["text"], pa.array(at), pa.array(cut, out["text"].type))
                if counted:
                    out["n_chars"] = pa.compute.replace_with_mask(
                        out["n_chars"], pa.array(at), pa.array([len(t) for t in cut], out["n_chars"].type))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=names)

    placed = plan(docs, share, most, shards, seed, carry=True).where("taken > 0")
    return placed.select("_row", "size", "_whole", "_place", "_blocks", "_rest", "_start", "_block").mapInArrow(run, docs.schema)


def op7_mixing(spark, sf_dir):
    return mix(documents(spark, sf_dir))


QUERIES = {"op7_mixing": op7_mixing}
