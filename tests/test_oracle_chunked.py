"""The queries over series again with chunks of a few rows, so that their chunked plans meet the SQL too."""

import pytest
from check_queries import compare, duck

import __spark_entry__ as contract
from condense.plans import bound, day_queries, frame_queries, motion_queries

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
CHUNKED = [
    "motion_threshold", "motion_smooth", "motion_segments", "motion_ratio", "median_energy", "early_terminate", "transitions",
    "label_axis", "analyze_files", "segment_merge", "day_timeline", "edit_list", "render_batches", "timeline_split",
    "segment_json", "all_transitions", "batch_files", "label_csv", "sample_stride", "frame_diff", "frame_energy", "frame_kernels", "prescreen_seek", "prescreen_stream",
    "frame_diff_binary", "frame_energy_binary", "prescreen_seek_binary", "prescreen_stream_binary", "score_to_verdict",
    "sampled_verdicts", "strided_energies", "early_known", "label_axis_true",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", CHUNKED)
def test_query_in_chunks(spark, con, monkeypatch, name):
    monkeypatch.setattr(bound, "SIZES", {"series": 7, "frames": 7})
    for module in (motion_queries, day_queries, frame_queries):
        monkeypatch.setattr(module, "SIZES", {"series": 7, "frames": 7})
    assert compare(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None
