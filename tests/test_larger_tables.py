"""Queries beside their SQL on tables whose last group is incomplete, as in larger tables."""

import os

import pytest
from oracle_compare import compare, connect

from __spark_entry__ import oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def cut_dir(tmp_path_factory):
    """Embeddings that end with 14 of 16 rows of a texture and 4 of 5 vectors of a mesh."""
    folder = str(tmp_path_factory.mktemp("cut"))
    connect(SF_DIR).execute(f"COPY (SELECT * FROM embeddings WHERE vec_id < 494) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", ["a29_mask_chain", "a29_mip_chain", "a43_level_invariants", "a44_seam_metrics", "s18_mesh_tables"])
def test_incomplete_last_group(spark, cut_dir, name):
    assert compare(queries()[name](spark, cut_dir), connect(cut_dir), oracle_sql()[name]) == ""
