"""From frames to an edit list, with and without chunks and detections."""

import math
import random

import pytest
from pyspark.sql import functions as F

from condense.operators import motion
from condense.plans.full_run import full_run, inspect, measured_frames, screen
from condense.session import written

SIDE = 4


def clip_frames(kind, n=60):
    if kind == "still":
        return [[100] * 16 for _ in range(n)]
    return [[100 + (90 if 20 <= i < 40 and i % 2 else 0)] * 16 for i in range(n)]  # moves in its middle third


def tables(spark):
    kinds = {"/a": ("still", "000000", "000100"), "/b": ("moving", "000100", "000200"), "/c": ("still", "000200", "000300")}
    frames = [(p, i, px) for p, (k, _, _) in kinds.items() for i, px in enumerate(clip_frames(k))]
    clips = [(p, "20240101", 0, "20240101" + a, "20240101" + b, 60.0, True) for p, (_, a, b) in kinds.items()]
    return (
        spark.createDataFrame(frames, "file_id string, i long, pixels array<int>"),
        spark.createDataFrame(
            clips,
            "path string, date string, cam_index int, file_start_time string, file_end_time string, file_duration double, has_audio boolean",
        ),
    )


@pytest.mark.parametrize("chunk", [16, 1024])
def test_day_with_one_moving_clip(spark, chunk):
    frames, clips = tables(spark)
    run = full_run(frames, clips, SIDE, SIDE, chunk_rows=chunk, frame_chunk=chunk, early_window=None, roi=(0, 0, 1, 1), keep=written)
    assert {r["file_id"]: r["status"] for r in run.verdicts.collect()} == {"/a": "STATIC", "/b": "SUSPICIOUS", "/c": "STATIC"}
    parts = sorted(run.edits.collect(), key=lambda r: r["seq"])
    assert [(r["state"], r["filepath"]) for r in parts] == [("STATIC", "/a"), ("DYNAMIC", "/b"), ("STATIC", "/c")]
    assert [r["audio"] for r in parts] == ["SILENT", "SOURCE", "SILENT"]
    moving = parts[1]
    # the short static rest of the clip is absorbed into the motion before it
    assert 15 < moving["start_in_file"] < 22 and 35 < moving["duration"] < 40
    assert parts[2]["output_start"] == pytest.approx(parts[0]["shown"] + moving["duration"])
    states = {r["path"]: (r["prescreen_status"], r["analysis_status"]) for r in run.registry.collect()}
    assert states == {"/a": ("STATIC", "PENDING"), "/b": ("SUSPICIOUS", "ANALYZED"), "/c": ("STATIC", "PENDING")}


def test_a_clip_without_frames_has_failed(spark):
    frames, clips = tables(spark)
    run = full_run(frames.where("file_id <> '/a'"), clips, SIDE, SIDE, early_window=None, roi=(0, 0, 1, 1))
    states = {r["path"]: (r["prescreen_status"], r["analysis_status"]) for r in run.registry.collect()}
    assert states["/a"] == ("FAILED", "PENDING") and len(states) == 3


def test_detections_turn_the_moving_part_static(spark):
    frames, clips = tables(spark)
    # 60 s at 5 frames per second: index 150 lies in the moving third; class 7 is no target
    seen = spark.createDataFrame([("/b", i, 7, 0.9) for i in range(0, 300, 10)], "file_id string, frame_idx long, class_id int, conf double")
    options = dict(early_window=None, roi=(0, 0, 1, 1), skip_energy=1000.0)
    run = full_run(frames, clips, SIDE, SIDE, detections=seen, sampled=seen.select("file_id", "frame_idx"), **options)
    assert {r["state"] for r in run.edits.collect()} == {"STATIC"}
    person = seen.withColumn("class_id", F.lit(0))
    run = full_run(frames, clips, SIDE, SIDE, detections=person, sampled=seen.select("file_id", "frame_idx"), **options)
    assert {r["state"] for r in run.edits.collect()} == {"STATIC", "DYNAMIC"}
    # frames were looked at and nothing was seen: the case the check is for
    nothing = full_run(frames, clips, SIDE, SIDE, detections=seen.limit(0), sampled=seen.select("file_id", "frame_idx"), **options)
    assert {r["state"] for r in nothing.edits.collect()} == {"STATIC"}
    assert {r["state"] for r in run.edits.collect()} == {"STATIC", "DYNAMIC"}


def test_inspection(spark):
    rows = [("x", k, 50.0 if 100 <= k < 160 else 1.0) for k in range(300)]
    energies = spark.createDataFrame(rows, "file_id string, k long, energy double")
    files = spark.createDataFrame([("x", 301.0, 0.0)], "file_id string, duration double, offset double")
    seen = spark.createDataFrame([("x", 0, 7, 0.9)], "file_id string, frame_idx long, class_id int, conf double")
    found = inspect(energies, files, seen, seen.select("file_id", "frame_idx"), early_window=None, chunk_rows=64)
    assert [r["direction"] for r in found["transitions"].orderBy("i").collect()] == ["MOTION_START", "MOTION_END"]
    assert [r["state"] for r in found["segments"].orderBy("seq").collect()] == ["STATIC", "DYNAMIC", "STATIC"]
    assert found["midpoints"].count() == 3
    assert found["statistics"].first()["motion_labels"] == 60


CLIPS = "path string, date string, cam_index int, file_start_time string, file_end_time string, file_duration double, has_audio boolean"


@pytest.mark.parametrize("chunk", [4, 1024])
def test_sampling_by_the_plain_rule(spark, chunk):
    rnd = random.Random(8)
    lengths = {"/short": 100.0, "/medium": 300.0, "/long": 700.0, "/unknown": None, "/zero": 0.0}
    data = {p: [[rnd.randint(60, 90)] * 16 for _ in range(rnd.randint(90, 130))] for p in lengths}
    data["/other"] = data["/short"]  # frames without a clip are not measured
    step = {p: (d or 300.0) / len(data[p]) for p, d in lengths.items()} | {"/other": 1.0}
    rows = [(p, i, i * step[p], px) for p, ps in data.items() for i, px in enumerate(ps)]
    frames = spark.createDataFrame(rows, "file_id string, i long, offset_s double, pixels array<int>")
    clips = spark.createDataFrame([(p, "20240101", 0, "20240101000000", "20240101000100", d, True) for p, d in lengths.items()], CLIPS)
    kept = {}
    for r in measured_frames(frames, clips, 20.0, chunk).collect():
        kept.setdefault(r["file_id"], {})[r["i"]] = r["pixels"]
    stride = {"/short": 4, "/medium": 10, "/long": 20, "/unknown": 10, "/zero": 10}
    assert kept == {p: dict(enumerate(data[p][::s])) for p, s in stride.items()}
    # the i-th sample is the last frame at or before the i-th of 11 points
    segments, verdicts = 10, {r["file_id"]: r for r in screen(frames, clips, 12.0, segments=10, frame_chunk=chunk).collect()}
    for p, d in lengths.items():
        d = d or 300.0
        rate = segments / max(d, 1.0)
        points = [max(j for j in range(len(data[p])) if math.ceil(j * step[p] * rate) <= i) for i in range(segments + 1)]
        seen = [data[p][j][0] for j in points]
        diffs = [max(abs(seen[i] - seen[i - 1]), abs(seen[i] - seen[0])) for i in range(1, len(seen))]
        stop = next((n for n, x in enumerate(diffs) if x > 12.0), None)
        assert verdicts[p]["checked_pairs"] == (segments if stop is None else stop + 1)
        assert verdicts[p]["status"] == ("STATIC" if stop is None else "SUSPICIOUS")


def test_run_over_samples(spark):
    frames, clips = tables(spark)
    timed = frames.withColumn("offset_s", F.col("i") * 1.0)
    run = full_run(timed, clips, SIDE, SIDE, screen_segments=15, native_fps=10.0, early_window=None, roi=(0, 0, 1, 1), keep=written)
    # samples lie 4 s apart and all see the dark frames of the moving clip: sampling misses it, as the rule says
    assert {r["status"] for r in run.verdicts.collect()} == {"STATIC"}
    run = full_run(timed, clips, SIDE, SIDE, screen_segments=60, native_fps=15.0, early_window=None, roi=(0, 0, 1, 1), keep=written)
    assert {r["file_id"]: r["status"] for r in run.verdicts.collect()} == {"/a": "STATIC", "/b": "SUSPICIOUS", "/c": "STATIC"}
    assert run.segments.count() > 0


def test_a_zero_closes_only_clips_of_known_length(spark):
    energies = spark.createDataFrame([(f, k, 1.0) for f in "abc" for k in range(9)], "file_id string, k long, energy double")
    files = spark.createDataFrame([("a", 20.0), ("b", 0.0), ("c", None)], "file_id string, duration double")
    cut = motion.cut_quiet_tail(energies, 4, 2.0, 4, files)
    assert {r["file_id"]: r["n"] for r in cut.groupBy("file_id").agg(F.count("k").alias("n")).collect()} == {"a": 5, "b": 4, "c": 4}
    runs = motion.analyze(energies, early_window=4, early_threshold=2.0, files=files.withColumn("offset", F.lit(5.0)), chunk_rows=4)
    assert {r["file_id"]: (r["last_i"], r["end_time"]) for r in runs.collect()} == {"a": (5, 25.0), "b": (4, 5.0), "c": (4, 5.0)}
