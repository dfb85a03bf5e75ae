"""A cross-section of the registered queries against their SQL.

``python tests/oracle_compare.py`` runs all of them.
"""

import os

import pytest
from oracle_compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = [
    "f02_script_letters", "f04_agreement_text", "f08_safe_component", "p04_color_filter", "a02_manifest_dedup",
    "a03_pixel_groups", "a04_tier_classification", "a06_run_summary", "k04_limit_on_pictures", "j18_box_overlap_pairs",
    "a07_consensus_reading", "a10_visual_suppression", "w05_expected_spans", "j06_external_materials",
    "j12_consumer_closure", "a45_graph_digest", "j20_snapshot_drift", "a20_change_measurement", "x05_nearest_fill",
    "a28_normal_mip", "a27_odd_diffuse_chain", "a29_odd_mask_chain", "a38_effect_support", "f18_derive_normal", "a35_merged_boundary", "x10_triangle_coverage",
    "w09_merge_ranges", "x09_differences_outside", "j19_plan_diff", "j37_preparation_request", "s03_pixel_fingerprint",
    "u0_batch_recognizer",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    assert compare(queries()[name](spark, SF_DIR), con, oracle_sql()[name]) == ""


def test_every_sql_text_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    assert entry(spark).count() > 0
