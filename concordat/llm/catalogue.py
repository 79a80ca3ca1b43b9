"""Queries of this subpackage and their oracle SQL (where SQL can express them)."""

from __future__ import annotations

from concordat.llm import (embedding_dedup, mixing, packing, periodic_runs, quality_rank, quality_rules, secret_scan,
                           sharding, simhash, spelling_variants, token_counts, toxicity, url_filter)

MODULES = (simhash, packing, token_counts, url_filter, secret_scan, sharding, mixing, quality_rank, quality_rules, embedding_dedup,
           periodic_runs, spelling_variants, toxicity)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE", {}).items()}
