"""Token cost accounting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat.functions.rounding import round_exact
from concordat.functions.text import as_col

# US dollars per million tokens.
PRICES = {
    "gpt-5-nano": {"input": 0.05, "output": 0.40, "cache": 0.005},
    "gpt-5-mini": {"input": 0.25, "output": 2.00, "cache": 0.025},
    "gpt-5": {"input": 1.25, "output": 10.00, "cache": 0.125},
    "gpt-5.1": {"input": 1.25, "output": 10.00, "cache": 0.125},
    "gpt-5.2": {"input": 1.75, "output": 14.00, "cache": 0.175},
    "gpt-5.4": {"input": 2.50, "output": 15.00, "cache": 0.25},
    "gpt-5.4-mini": {"input": 0.75, "output": 4.50, "cache": 0.075},
    "gpt-5.4-nano": {"input": 0.20, "output": 1.25, "cache": 0.02},
    "gpt-4.1": {"input": 2.00, "output": 8.00, "cache": 0.50},
    "gpt-4o": {"input": 2.50, "output": 10.00, "cache": 1.25},
}

MILLION = 1_000_000


def price(model: Column | str, kind: str) -> Column:
    """Price of ``kind`` tokens for a model column; NULL for unknown models."""
    m = as_col(model)
    out = F.lit(None).cast("double")
    for name, prices in PRICES.items():
        out = F.when(m == name, F.lit(prices[kind])).otherwise(out)
    return out


def _dollars(tokens: Column, per_million: Column) -> Column:
    return round_exact(tokens * per_million / MILLION, 4)


def usage_cost(model: Column | str, input_tokens: Column, cached_tokens: Column, reasoning_tokens: Column,
               output_tokens: Column, memo_hit: Column | None = None) -> Column:
    """Billing struct of one call.

    Reasoning tokens are billed next to the output tokens, which already hold
    them; ``what_if_cost`` does not, so savings can be negative. Kept as is.
    """
    hit = F.coalesce(memo_hit, F.lit(False)) if memo_hit is not None else F.lit(False)
    zero = F.lit(0.0)
    paid = {
        "input_cost": _dollars(input_tokens - cached_tokens, price(model, "input")),
        "cache_cost": _dollars(cached_tokens, price(model, "cache")),
        "reasoning_cost": _dollars(reasoning_tokens, price(model, "output")),
        "output_cost": _dollars(output_tokens, price(model, "output")),
    }
    paid = {name: F.when(hit, zero).otherwise(value) for name, value in paid.items()}
    total = round_exact(sum(paid.values(), zero), 4)
    counts = {"input_tokens": input_tokens, "cached_tokens": cached_tokens,
              "reasoning_tokens": reasoning_tokens, "output_tokens": output_tokens}
    return F.struct(*[c.alias(n) for n, c in {**counts, **paid}.items()],
                    total.alias("total_cost"), hit.alias("memo_hit"))


def what_if_cost(model: Column | str, input_tokens: Column, output_tokens: Column) -> Column:
    """Cost had nothing been cached; NULL when tokens or price are unknown."""
    return round_exact(input_tokens * price(model, "input") / MILLION
                    + output_tokens * price(model, "output") / MILLION, 4)


def savings(what_if: Column, used: Column) -> Column:
    return round_exact(what_if - used, 4)


def cache_status(memo_hit: Column, cached_tokens: Column) -> Column:
    return (F.when(memo_hit, "memo_hit").when(cached_tokens.isNull(), "unknown")
            .when(cached_tokens > 0, "hit").otherwise("miss"))


def input_tokens_used(input_tokens: Column, cached_tokens: Column) -> Column:
    fresh = input_tokens - F.coalesce(cached_tokens, F.lit(0))
    return F.when(input_tokens.isNotNull(), F.greatest(fresh, F.lit(0)))
