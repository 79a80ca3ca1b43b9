"""All catalogue queries and their oracle SQL."""

from __future__ import annotations

from concordat.plans import artifacts, evaluation, layout, normalization, records, scores, taxon, texts

MODULES = (evaluation, normalization, taxon, records, texts, scores, layout, artifacts)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
