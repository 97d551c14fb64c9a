"""Registered queries against DuckDB at sf0.001: a cross-section by default, all of them with MEMJOIN_ALL=1."""

import os

import pytest

from memjoin.plans import load_all
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "j4_idf_token_scores", "j1_exact_vector_topk", "j1_exact_vector_topk_blocks", "w2_token_budget_packing", "w3_packing_with_blocks", "a23_ranked_metrics", "f3_fnv1a64", "f9_hash_embedding", "j24_associative_recall",
    "j29_bidirectional_graph_expansion", "j7_bounded_bucket", "a3_field_promotion_gate", "j14_field_token_emission", "j33_basin_rollup", "v9_selector_features_31", "p5_normalize_evidence", "p17_decoy_augmentation", "t2_memory_state_fold",
    "x5_ordered_fold", "a8_quantile_summary", "s3_sanitize_and_slice",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(load_all()) if os.environ.get("MEMJOIN_ALL") else SAMPLE)
def test_matches_sql(spark, con, name):
    verdict, _, _ = compare(spark, con, load_all()[name], SF)
    assert verdict.startswith("ok") or verdict.startswith("rows-only"), verdict


def test_entry_points(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(load_all()) <= set(E.queries())
