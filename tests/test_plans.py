"""What the plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from condense.operators import frames as fr, motion, segments as seg, verify as vf
from condense.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def unaided(spark):
    """No broadcasts and no runtime re-planning: the plan for large tables."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


PLANNED = [n for n in catalogue.QUERIES if not n.startswith("stream_")]


@pytest.mark.parametrize("name", PLANNED)
def test_no_pairwise_joins_and_no_global_windows(spark, name):
    text = plan(contract.queries()[name](spark, SF_DIR))
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text
    assert not re.search(r"Exchange SinglePartition.*\n.*\n.*Window", text)


def energies(spark, path):
    spark.range(10).selectExpr("cast(id % 2 as string) file_id", "id div 2 k", "double(id) energy").write.parquet(path)
    return spark.read.schema("file_id string, k long, energy double").parquet(path)


def test_row_windows_run_inside_chunks(unaided, tmp_path):
    df = energies(unaided, str(tmp_path / "e"))
    labels = motion.raw_labels(df, motion.noise_threshold(df))
    text = plan(motion.label_runs(labels, smooth=False))
    # windows over a key alone only see summaries: bins of a histogram
    for part in re.findall(r"Window \[.*?\], \[(.*?)\](?:, \[(.*?)\])?\n", text):
        keys, order = (re.sub(r"#\d+L?", "", p) for p in part)
        assert any(k in keys for k in ("_chunk", "_place", "_bin")) or order.startswith("_bin") or order == "", part


def test_threshold_join_and_run_windows_share_an_exchange(unaided, tmp_path):
    df = energies(unaided, str(tmp_path / "e"))
    labels = motion.raw_labels(df, motion.noise_threshold(df))
    text = plan(motion.label_runs(labels, smooth=False))
    above_join = text.split("SortMergeJoin")[0]
    assert above_join.count("Exchange hashpartitioning") == 1  # the one that brings border runs together


def test_sampled_frames_meet_their_segments_in_one_shuffle(unaided, tmp_path):
    unaided.range(9).selectExpr("id % 2 file_id", "id frame_idx", "int(id) class_id", "0.5D conf").write.parquet(str(tmp_path / "d"))
    unaided.range(9).selectExpr("id file_id", "0 segment_id", "0D start_time", "9D end_time", "0D file_start_offset").write.parquet(str(tmp_path / "s"))
    seen, segments = (unaided.read.parquet(str(tmp_path / n)) for n in "ds")
    hits = vf.sampled_hits(seen.select("file_id", "frame_idx"), seen, block=vf.FRAME_BLOCK)
    pairs = vf.segment_frames(segments, hits, F.lit(1.0))
    assert plan(pairs).count("Exchange hashpartitioning") == 2  # frames with detections, and segments
    assert {(r["frame_idx"], r["hit"]) for r in pairs.collect()} == {(i, i < 4) for i in range(9)}


def test_frames_are_shuffled_once(unaided, tmp_path):
    path = str(tmp_path / "f")
    unaided.range(10).selectExpr("cast(id % 2 as string) file_id", "id div 2 i", "array(int(id)) pixels").write.parquet(path)
    frames = unaided.read.schema("file_id string, i long, pixels array<int>").parquet(path)
    text = plan(fr.prescreen(fr.frame_changes(frames)))
    assert text.split("SortMergeJoin")[0].count("Exchange") == 1  # per-file summary of chunk rows


def test_only_needed_columns_are_read(unaided, tmp_path):
    df = energies(unaided, str(tmp_path / "e"))
    text = plan(motion.every_kth(df, "k", 5).select("file_id", "k"))
    assert "ReadSchema: struct<file_id:string,k:bigint>" in text


def test_range_join_has_an_equi_key(unaided):
    segments = unaided.createDataFrame(
        [("f", 0, 0.0, 5.0, "DYNAMIC", 0.0, 1.0)],
        "file_id string, segment_id long, start_time double, end_time double, state string, file_start_offset double, max_energy double",
    )
    frames = unaided.createDataFrame([("f", 1, True)], "file_id string, frame_idx long, hit boolean")
    text = plan(vf.segment_frames(segments, frames, F.lit(1.0)))
    assert re.search(r"SortMergeJoin \[file_id#\d+, _block#\d+L?\]", text)


def test_first_transitions_are_limited_before_the_shuffle(unaided, tmp_path):
    df = energies(unaided, str(tmp_path / "e"))
    runs = motion.label_runs(motion.raw_labels(df, motion.noise_threshold(df)), smooth=False)
    assert "WindowGroupLimit" in plan(seg.transitions(runs, 40))
