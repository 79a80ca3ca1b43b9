"""Operator 6, shards by a k-d tree over document metadata. DataFrame functions only.

All documents are one cell at first. Each cell is split, along the metadata
dimension in which it is widest, at the point where the bytes on either side are
as its two halves of the shards need; halves are split again until every cell is
one shard, whose bytes are then near the target. Widths are relative to the
width over all documents.

A split point is found without sorting: bytes are summed in ``bins`` equal
intervals of the cell, and again inside the interval that holds the point, until
that interval has a negligible part of the cell. Every pass is one aggregation
over all cells of a level whose result has cells x bins rows at most; a path of
the tree is a plain expression, so documents move only once, for the numbers
within a shard.

Coordinates are longs: the value (source, language or the logarithm of the
size) above 20 bits of the text's hash and 8 of the id's hash. So one source
that holds a third of all rows can be split, documents of equal text stay
neighbours, and even a hot text is divided evenly.

Edge cases: a null or empty text has size 1 and the CRC of no bytes; null
sources and languages come before all others; repeated rows are placed each for
themselves; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import documents, pinned
from concordat.llm.ranks import with_rank

#: Bits of a coordinate below its value: of the text's hash and of the id's hash.
TEXT_BITS, ID_BITS = 20, 8
VALUE_BITS = 62 - TEXT_BITS - ID_BITS
DIMENSIONS = ("source", "lang", "size")


def _name_value(column: str) -> Column:
    """A string's order by its first four bytes, as a long; 0 for null."""
    head = F.rpad(F.hex(F.substring(F.encode(F.col(column).cast("string"), "UTF-8"), 1, 4)), 8, "0")
    return F.coalesce((F.conv(head, 16, 10).cast("long") + 1), F.lit(0))


def _coordinates(docs: DataFrame) -> DataFrame:
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    sized = docs.select("doc_id", *[F.col(c) for c in ("source", "lang")], F.octet_length(raw).cast("long").alias("_n"),
                        F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("_text"))
    sized = sized.withColumn("size", F.col("_n") + 1)
    tie = F.shiftright(F.col("_text"), 64 - TEXT_BITS).bitwiseAND((1 << TEXT_BITS) - 1) * (1 << ID_BITS)
    tie = tie + F.xxhash64(F.lit(3), "doc_id").bitwiseAND((1 << ID_BITS) - 1)
    # Logarithm of the size in steps fine enough to part any two sizes of a cell.
    size = F.least((F.log2("size") * (1 << (VALUE_BITS - 7))).cast("long"), F.lit((1 << VALUE_BITS) - 1))
    values = {"source": _name_value("source"), "lang": _name_value("lang"), "size": size}
    return sized.select("doc_id", "size", "text_crc32", *[
        (v * (1 << (TEXT_BITS + ID_BITS)) + tie).alias(f"_at_{name}") for name, v in values.items()])


def _parts(frame: DataFrame, cell: Column, level: dict, bins: int) -> dict:
    """Bytes by bin of each cell's present interval: {cell: {bin: bytes}}, in one aggregation."""
    spot = F.lit(None)
    for c, s in level.items():
        at = F.col(f"_at_{s['dim']}")
        inside = (at >= s["low"]) & (at < s["high"])
        # Intervals are powers of two times the bins, so a bin is a shift.
        spot = F.when(cell == c, F.when(inside, F.shiftright(at - F.lit(s["low"]), s["shift"]))).otherwise(spot)
    rows = frame.select(cell.alias("cell"), spot.alias("bin"), "size").where("bin is not null").groupBy(
        "cell", "bin").agg(F.sum("size").alias("bytes")).collect()
    out: dict = {c: {} for c in level}
    for r in rows:
        out[r["cell"]][r["bin"]] = r["bytes"]
    return out


def split_points(frame: DataFrame, shards: int, bins: int = 1024, tolerance: float = 0.0005) -> list[tuple[int, str, int, int, int]]:
    """(cell, dimension, point, left cell, right cell) of every split, root first. Cells are numbered by path."""
    tree: list[tuple[int, str, int, int, int]] = []
    cells, number = {0: shards}, 1
    every = None
    while any(n > 1 for n in cells.values()):
        cell = path(tree)
        extent = frame.groupBy(cell.alias("cell")).agg(
            F.sum("size").alias("bytes"), *[f(f"_at_{d}").alias(f"{n}_{d}") for d in DIMENSIONS
                                            for n, f in (("low", F.min), ("high", F.max))]).collect()
        extent = {r["cell"]: r for r in extent}
        if not extent:
            break
        every = every or {d: max(extent[0][f"high_{d}"] - extent[0][f"low_{d}"], 1) for d in DIMENSIONS}
        level = {}
        for c, n in cells.items():
            if n == 1 or c not in extent:
                continue
            r = extent[c]
            dim = max(DIMENSIONS, key=lambda d: (r[f"high_{d}"] - r[f"low_{d}"]) / every[d])
            low, wide = r[f"low_{dim}"], r[f"high_{dim}"] - r[f"low_{dim}"] + 1
            shift = max(0, (wide - 1).bit_length() - (bins.bit_length() - 1))
            level[c] = {"dim": dim, "low": low, "high": low + wide, "shift": shift, "bytes": r["bytes"],
                        "want": r["bytes"] * (n // 2) / n, "left": 0, "point": None}
        while open_cells := {c: s for c, s in level.items() if s["point"] is None}:
            for c, counts in _parts(frame, cell, open_cells, bins).items():
                s, done = level[c], level[c]["left"]
                for b in sorted(counts):
                    if done + counts[b] >= s["want"]:
                        break
                    done += counts[b]
                start = s["low"] + (b << s["shift"])
                if s["shift"] == 0 or counts[b] <= tolerance * s["bytes"]:
                    # The point goes before or after this bin, whichever is nearer.
                    after = done + counts[b] - s["want"] < s["want"] - done
                    s["point"] = start + (1 << s["shift"]) if after else start
                else:
                    s.update(left=done, low=start, high=start + (1 << s["shift"]),
                             shift=max(0, s["shift"] - (bins.bit_length() - 1)))
        split: dict[int, int] = {}
        for c, n in cells.items():
            if c in level:
                tree.append((c, level[c]["dim"], level[c]["point"], number, number + 1))
                split |= {number: n // 2, number + 1: n - n // 2}
                number += 2
            elif n == 1:
                split[c] = 1
        cells = split
    return tree


def path(tree: list[tuple[int, str, int, int, int]]) -> Column:
    """The cell of a row after all splits of ``tree``, as one expression."""
    sides = {c: (dim, point, left, right) for c, dim, point, left, right in tree}

    def below(c: int) -> Column:
        if c not in sides:
            return F.lit(c)
        dim, point, left, right = sides[c]
        return F.when(F.col(f"_at_{dim}") < point, below(left)).otherwise(below(right))

    return below(0)


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document; see the module's text."""
    frame = pinned(_coordinates(docs).withColumn("_task", F.spark_partition_id()))
    tree = split_points(frame, shards)
    parents = {c for c, *_ in tree}
    leaves = [c for c in [0, *(x for t in tree for x in t[3:])] if c not in parents]
    number = reduce(lambda out, x: F.when(F.col("_cell") == x[1], x[0]).otherwise(out), enumerate(leaves), F.lit(0))
    placed = frame.withColumn("_cell", path(tree)).withColumn("shard", number.cast("int"))
    ranked = with_rank(placed, ["shard"], "_task", [F.col("doc_id"), F.col("text_crc32")], "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark, sf_dir):
    return shard(documents(spark, sf_dir))


QUERIES = {"op6_sharding": op6_sharding}
