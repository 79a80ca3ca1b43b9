"""Running totals over an order, without gathering the order in one task.

A plain ``Window.orderBy`` with no partition key - or with one hot key - sorts
everything in a single task. Here the order ``(keys, order)`` is cut into slices at
bounds taken from a bounded sample. A row's slice is then an expression on its own
columns, the same in every pass and after any lost task, so nothing has to be
written down between them:

* sums by (slice, key) are partially aggregated where the rows are read;
* what the slices before one add up to is a header row of that slice and key;
* rows and headers move once, to their slice, and one window sums them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled rows for each slice; they decide how even slices are, not what comes out.
SAMPLED = 32


def _after(names: list[tuple[str, bool]], bound) -> Column:
    """Whether a row is at ``bound`` or behind it. Nulls come first ascending and last descending, as in a sort."""
    out = F.lit(True)
    for (name, descending), value in reversed(list(zip(names, bound))):
        c = F.col(name)
        if value is None:
            behind = F.lit(False) if descending else c.isNotNull()
        else:
            behind = c.isNull() | (c < F.lit(value)) if descending else c > F.lit(value)
        out = F.coalesce(behind, F.lit(False)) | (c.eqNullSafe(F.lit(value)) & out)
    return out


def slice_of(df: DataFrame, names: list[tuple[str, bool]], slices: int) -> Column:
    """The number of a row's slice in the order of ``names`` (column, descending), from 0; at most ``slices`` of them."""
    columns = [n for n, _ in names]
    order = [F.col(n).desc() if d else F.col(n) for n, d in names]
    sample = df.select(*columns).orderBy(F.xxhash64(*columns)).limit(SAMPLED * slices)
    rows = sample.orderBy(*order).collect()  # at most SAMPLED rows for each slice
    bounds = [rows[i * len(rows) // slices] for i in range(1, slices)] if len(rows) >= slices else rows[1:]

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(_after(names, bounds[middle]), among(middle + 1, high)).otherwise(among(low, middle))

    return among(0, len(bounds))


def running_totals(df: DataFrame, order: list[tuple[str, bool]], sums: dict[str, Column], *, keys: list[str] | None = None,
                   slices: int | None = None) -> DataFrame:
    """Add inclusive running sums in ``order``, a list of (column, descending), per ``keys`` group if given.

    ``order`` must be total (end with a unique column) for a fixed result. Rows are exchanged once.
    """
    keys = keys or []
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = {f"_v_{name}": value for name, value in sums.items()}
    number = slice_of(df, [*((k, False) for k in keys), *order], slices)
    sliced = df.select("*", number.alias("_slice"), *[v.alias(n) for n, v in values.items()])

    # One row per slice and key that occurs in it: at most keys + slices rows, and at most ``slices`` in a window partition.
    totals = sliced.groupBy("_slice", *keys).agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    headers = totals.select("_slice", *keys, *[F.sum(v).over(before).alias(v) for v in values], F.lit(True).alias("_header"))
    headers = headers.where(" OR ".join(f"{v} IS NOT NULL" for v in values))

    kinds = dict(headers.dtypes)
    rows = sliced.withColumns({v: F.col(v).cast(kinds[v]) for v in values}).withColumn("_header", F.lit(False))
    together = rows.unionByName(headers, allowMissingColumns=True).repartition(slices, "_slice")
    within = Window.partitionBy("_slice", *keys).orderBy(F.desc("_header"), *[F.col(n).desc() if d else F.col(n) for n, d in order])
    within = within.rowsBetween(Window.unboundedPreceding, 0)
    summed = together.withColumns({name: F.coalesce(F.sum(v).over(within), F.lit(0)) for name, v in zip(sums, values)})
    return summed.where(~F.col("_header")).select(*df.columns, *sums)
