"""Operator 2, packing token sequences by cutting-stock column generation.

Each document becomes its token ids and one closing id, cut at multiples of the
sequence length; the pieces are counted in a histogram of length classes. The
master problem, a linear program over patterns (how many pieces of each class
share a sequence), is solved by column generation: a knapsack dynamic program
over the row prices finds the pattern to enter, until the gap to the bound is
small. Patterns are rounded down to whole sequences and pieces, ranked within
their class, take the slots. What rounding leaves over - at most one sequence
for each pattern, whatever the size of the data - is packed first-fit by exact
length.

The driver sees the histogram, the patterns and those left-over pieces; all are
bounded by the number of classes. Ids are checked by a CRC, not stored.

Edge cases: null and empty texts are the closing id alone; repeated rows, also
of one id, and null ids are packed each for themselves; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from struct import pack as pack_ints
from zlib import crc32

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordat.llm.common import blocks, documents, pinned
from concordat.llm.token_counts import KEPT, VOCABULARY, compiled


def little_endian(ids: list[int]) -> bytes:
    """Ids as unsigned 32-bit integers."""
    return pack_ints(f"<{len(ids)}I", *ids)


def steady_characters() -> np.ndarray:
    """Code points that were letter, number, space or other in Unicode 3.2 and still are: all splitters agree on them."""
    def kind(c: str, table) -> str:
        name = table.category(c)
        return name if name == "Cn" or name[0] == "C" else "S" if c.isspace() else name[0] if name[0] in "LN" else "O"

    out = np.zeros(0x110000, bool)
    for point in range(0x10000):
        c = chr(point)
        before, now = kind(c, unicodedata.ucd_3_2_0), kind(c, unicodedata)
        out[point] = before == now and before not in ("Cn", "Cs", "Co")
    return out


class Encoder:
    """Ids of texts as the vocabulary's own library gives them.

    Texts of characters that all Unicode tables class alike are encoded whole by
    the fast implementation of the same vocabulary; in all others the compiled
    splitter finds the pieces, and the library encodes each distinct one once.
    """

    def __init__(self, name: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.cascade, self.library = compiled(name), Tokenizer.from_file(public_tokenizers.path(name))
        # In this vocabulary ids are ranks: bytes first, then merges in order.
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(self.cascade.merger.tokens),
                                      special_tokens={})
        self.steady = steady_characters()
        self.kept: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts, owner, after = self.cascade.split_added(texts)
        odd = [i for i, p in enumerate(parts)
               if not p.isascii() and not self.steady[np.frombuffer(p.encode("utf-32-le"), np.uint32)].all()]
        coded = dict(zip(odd, self._by_pieces([parts[i] for i in odd])))
        out: list[list[bytes]] = [[] for _ in texts]
        for i, (p, o, a) in enumerate(zip(parts, owner, after)):
            if i not in coded:
                coded[i] = self.fast.encode_to_numpy(p, disallowed_special=()).astype("<u4").tobytes()
            out[o].append(coded[i])
            if a >= 0:
                out[o].append(little_endian([a]))
        return [b"".join(x) for x in out]

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        pieces, per = self.cascade.pieces(texts)
        if len(self.kept) > KEPT:
            self.kept.clear()
        new = list(set(pieces).difference(self.kept))
        self.kept.update(zip(new, [little_endian(code.ids) for code in self.library.encode_batch_fast(
            new, add_special_tokens=False)]))
        codes, ends = list(map(self.kept.__getitem__, pieces)), np.cumsum(per)
        return [b"".join(codes[a:b]) for a, b in zip((ends - per).tolist(), ends.tolist())]


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(name)


def pieces(docs: DataFrame, vocabulary: str, length: int, grain: int, closing: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, class, task, local): pieces, numbered by class within a task."""
    end = little_endian([closing])

    def run(batches):
        task, seen = TaskContext.get().partitionId(), {}
        for part, texts in blocks(batches):
            rows: list[list] = [[] for _ in range(8)]
            for i, ids in enumerate(encoder(vocabulary).encode([t.decode() for t in texts])):
                ids += end
                for at in range(0, len(ids), 4 * length):
                    piece = ids[at:at + 4 * length]
                    size = len(piece) // 4
                    kind = -(-size // grain)
                    local = seen.get(kind, 0)
                    seen[kind] = local + 1
                    for column, v in zip(rows, (i, at // 4, size, crc32(piece), len(ids) // 4, kind, task, local)):
                        column.append(v)
            ints = [pa.array(c, pa.int64()) for c in rows]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(ints[0]), *ints[1:]], names=names)

    schema = docs.select("doc_id").schema
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "task", "local"]
    for n in names[1:]:
        schema = schema.add(n, "long")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def cutting_stock(capacity: int, sizes: np.ndarray, demand: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns: pieces of each size) and how often to use each, a basic solution of the linear program.

    ``sizes`` ascend. Ends when no pattern's price exceeds 1 + gap: the value
    is then within that factor of the optimum.
    """
    m = len(sizes)
    fill = capacity // sizes
    patterns, inverse, used = np.diag(fill).astype(float), np.diag(1.0 / fill), demand / fill
    first = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for _ in range(20 * m):
        prices = inverse.sum(0)
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(1, capacity + 1):
            best[c] = best[c - 1]
            if k := first[c]:
                value = prices[:k] + best[c - sizes[:k]]
                j = int(value.argmax())
                if value[j] > best[c] + 1e-12:
                    best[c], choice[c] = value[j], j
        if best[capacity] <= 1 + gap:
            break
        column, c = np.zeros(m), capacity
        while c > 0:
            if (j := choice[c]) < 0:
                c -= 1
            else:
                column[j] += 1
                c -= sizes[j]
        step = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, np.maximum(used, 0) / step, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        used = used - ratio[out] * step
        used[out] = ratio[out]
        inverse[out] /= step[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        patterns[:, out] = column
    return patterns.astype(np.int64), np.maximum(used, 0)


def whole_sequences(patterns: np.ndarray, used: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """Each pattern's uses rounded down, and never more pieces than there are."""
    times = np.floor(used + 1e-6).astype(np.int64)
    over = patterns @ times - demand
    while (over > 0).any():
        c = int(over.argmax())
        p = int(np.where((patterns[c] > 0) & (times > 0), patterns[c], 0).argmax())
        times[p] -= 1
        over = patterns @ times - demand
    return times


def slots(classes: np.ndarray, patterns: np.ndarray, times: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of ranks of a class that one pattern takes: class, first rank, end, sequence base, pieces a sequence."""
    base = np.cumsum(times) - times
    rows = []
    for c, kind in enumerate(classes.tolist()):
        at = 0
        for p in np.flatnonzero((patterns[c] > 0) & (times > 0)).tolist():
            n = int(times[p] * patterns[c, p])
            rows.append((kind, at, at + n, int(base[p]), int(patterns[c, p])))
            at += n
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("class", "first", "end", "base", "each"), columns))


def first_fit(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each length, longest first, each into the fullest bin that holds it."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what they still hold
    out, bins = [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = next((r for r in range(lengths[i], capacity + 1) if rooms[r]), None)
        if room is None:
            out[i], bins, room = bins, bins + 1, capacity
        else:
            out[i] = rooms[room].pop()
        rooms[room - lengths[i]].append(out[i])
    return out


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = 1024, closing: int = 0, grain: int = 8,
         gap: float = 0.002) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece; see the module's text.

    ``grain``: tokens by which length classes differ; pieces of a class count
    as its longest, so it bounds the padding for each piece. Offsets count the
    tokens that are really there.
    """
    items = pinned(pieces(docs, vocabulary, length, grain, closing))
    spark = docs.sparkSession
    counted = pinned(items.groupBy("class", "task").count())
    histogram = dict(counted.groupBy("class").agg(F.sum("count")).collect())
    classes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[c] for c in classes.tolist()], np.int64)
    if len(classes):
        patterns, used = cutting_stock(length // grain, classes, demand.astype(float), gap)
        times = whole_sequences(patterns, used, demand)
    else:
        patterns, times = np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
    runs, planned = slots(classes, patterns, times), int(times.sum())

    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("class", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = items.join(offsets, ["class", "task"]).withColumn("rank", F.col("_before") + F.col("local")).drop("_before")

    def place(batches):
        for batch in batches:
            kind, rank = (batch.column(n).to_numpy() for n in ("class", "rank"))
            sequence, slot = np.full(len(kind), -1), np.zeros(len(kind), np.int64)
            for c in np.unique(kind) if len(runs["class"]) else ():
                own, mine = np.flatnonzero(kind == c), runs["class"] == c
                first, end, base, each = (runs[n][mine] for n in ("first", "end", "base", "each"))
                if len(first):
                    at = np.searchsorted(first, rank[own], side="right") - 1
                    inside = rank[own] < end[at]
                    own, at = own[inside], at[inside]
                    sequence[own] = base[at] + (rank[own] - first[at]) // each[at]
                    slot[own] = c * 8192 + (rank[own] - first[at]) % each[at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(slot)],
                                             names=[*batch.schema.names, "sequence_id", "slot"])

    both = ranked.withColumns({"sequence_id": F.lit(0).cast("long"), "slot": F.lit(0).cast("long")})
    placed = pinned(ranked.mapInArrow(place, both.schema))
    left = placed.where("sequence_id < 0").select("task", "class", "local", "length").collect()
    left.sort()
    bins = first_fit([r["length"] for r in left], length)
    seats = spark.createDataFrame([(r[0], r[1], r[2], planned + b, i) for i, (r, b) in enumerate(zip(left, bins))],
                                  "task long, class long, local long, _sequence long, _slot long")
    rest = placed.where("sequence_id < 0").drop("sequence_id", "slot").join(F.broadcast(seats), ["task", "class", "local"])
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    both = placed.where("sequence_id >= 0").select(*columns, "sequence_id", "slot").unionAll(
        rest.select(*columns, F.col("_sequence").alias("sequence_id"), F.col("_slot").alias("slot")))
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return both.select(*columns, "sequence_id",
                       F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"))


def op2_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir))


QUERIES = {"op2_packing": op2_packing}
