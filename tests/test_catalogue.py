"""Catalogue contract, and a cross-section of queries against DuckDB at the smallest scale."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ("eval_micro_macro", "eval_taxon_list", "mismatch_categories", "normalize_features", "validate_quarantine",
          "taxon_resolve", "manifest_build", "upsert_two_columns", "run_kpis", "relevance_rules", "heading_classify",
          "sentence_split", "section_prompt", "vector_topk_filtered", "score_stability", "confidence_curve",
          "reattach_by_place", "side_by_side_files", "sample_rows", "sample_per_key", "evidence_quarantine", "evidence_accepted",
          "eval_fuzzy_metrics", "eval_taxon_list_join", "score_describe", "manifest_csv_round_trip", "evaluation_round_trip",
          "extraction_csv_round_trip", "json_arrays_read", "run_artifact_round_trip", "extraction_csv_maps", "outcome_split",
          "status_chain", "reasoning_settings")

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's test tables")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, name):
    assert compare(spark, connect(SF), SF, entry.queries()[name], entry.oracle_sql()[name]) == ""


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 7
