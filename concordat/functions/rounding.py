"""Decimal rounding that agrees with Python's ``round`` and with NumPy's.

``bround`` rounds the shortest decimal text of a double; Python rounds the
binary value itself, which decides ties such as 0.00125 differently.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat.functions.text import let

_SPLIT = 134217729.0  # 2**27 + 1, Veltkamp's splitting constant


def round_exact(value: Column, digits: int) -> Column:
    """Half to even on the exact binary value.

    The product ``x * 10**digits`` is formed with its rounding error (Dekker),
    so a product that only looks like a tie is recognised.
    """
    scale = float(10 ** digits)

    def pieces(x: Column) -> Column:
        high = x * _SPLIT - (x * _SPLIT - x)
        product = x * scale
        return F.struct(product.alias("p"), ((high * scale - product) + (x - high) * scale).alias("e"))

    def decide(c: Column) -> Column:
        whole = F.floor(c["p"]).cast("double")
        rest = c["p"] - whole
        up = (rest > 0.5) | ((rest == 0.5) & ((c["e"] > 0) | ((c["e"] == 0) & (whole % 2 != 0))))
        return (whole + F.when(up, 1.0).otherwise(0.0)) / scale

    return let(let(value.cast("double"), pieces), decide)


def round_numpy(value: Column, digits: int) -> Column:
    """NumPy and pandas: scale, nearest even integer, scale back."""
    scale = float(10 ** digits)
    return F.rint(value.cast("double") * scale) / scale
