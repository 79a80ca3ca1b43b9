"""Seeded samples of exactly n rows, for a table or for each key, that no layout changes.

A row's rank is a seeded hash of its columns; the sample is the n rows of least
rank. Any part of the table gives a sketch (its own n least), sketches merge into the
sketch of the union, in any order, so tasks cut their rows while they read and a tree
of merges does the rest. The table is never sorted, and what moves is at most n rows
for each task (and key).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK = "_rank"
#: Rows a task keeps before it cuts them again, or sends them on.
HELD = 1 << 16


def rank(seed: int, columns: list[str]) -> Column:
    """A number below 2 ** 60 from the seed and the columns' texts; NULL and the empty text differ."""
    texts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *texts)), 1, 15), 16, 10).cast("bigint")


def _least(ranks: np.ndarray, keys: np.ndarray | None, n: int) -> np.ndarray:
    """Places of the n least ranks (of each key), ascending."""
    if keys is None:
        return np.sort(np.argpartition(ranks, n - 1)[:n]) if len(ranks) > n else np.arange(len(ranks))
    order = np.lexsort((ranks, keys))
    first = np.searchsorted(keys[order], keys[order])
    return np.sort(order[np.arange(len(order)) - first < n])


def _cut(table: pa.Table, n: int, by: tuple[str, ...]) -> pa.Table:
    keys = None
    if by:
        code = np.zeros(table.num_rows, np.int64)
        for column in by:
            encoded = table.column(column).combine_chunks().dictionary_encode(null_encoding="encode")
            encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
            code = np.unique(code * (len(encoded.dictionary) + 1) + encoded.indices.to_numpy(), return_inverse=True)[1]
        keys = code
    return table.take(pa.array(_least(table.column(RANK).to_numpy(), keys, n)))


def sketch(df: DataFrame, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Each task's ``n`` rows of least rank (column ``_rank``), for each of its keys ``by``.

    With more keys than a task holds, rows are sent on a little early; later merges cut them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(_cut(pa.Table.from_batches([batch]), n, by))
            rows += held[-1].num_rows
            if rows > 2 * max(n, HELD):
                held = [_cut(pa.concat_tables(held), n, by)]
                rows = held[0].num_rows
                if rows > max(n, HELD):  # only with many keys
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from _cut(pa.concat_tables(held), n, by).to_batches()

    return df.mapInArrow(run, df.schema)


def merged(sketches: DataFrame, n: int, by: tuple[str, ...] = (), fan_in: int = 64) -> DataFrame:
    """The sketch of all rows: for each key by one exchange of what the tasks kept, without keys by a tree of merges."""
    if by:
        least = Window.partitionBy(*by).orderBy(RANK)
        return sketches.withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= n).drop("_n")
    width = int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while width > 1:
        width = -(-width // fan_in)
        sketches = sketch(sketches.repartition(width, F.col(RANK)), n)
    return sketches


def sample(df: DataFrame, n: int, seed: int, *, by: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """``n`` rows of ``df`` (of each key ``by``), all of them if there are fewer.

    ``columns`` are those that tell rows apart (default: all); rows that agree in
    them are drawn together. The same rows come out of any partitioning, order and number of tasks.
    """
    if n < 1:
        return df.limit(0)
    keys = tuple(by or ())
    ranked = df.withColumn(RANK, rank(seed, columns or df.columns))
    return merged(sketch(ranked, n, keys), n, keys).drop(RANK)
