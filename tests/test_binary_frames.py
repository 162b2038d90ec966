"""BINARY frames give what the same frames give as arrays; detections from pixels to the verdict."""

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from test_frames import clips, table

from condense.operators import frames as fr, verify as vf

SCHEMA = "file_id string, i long, pixels binary"


def as_bytes(spark, data):
    rows = [(f, i, None if p is None else bytes(p)) for f, ps in data.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_same_changes_and_energies(spark, chunk):
    data = clips(5, 12)
    columns = ["file_id", "i", "_chunk", "luma", "diff_prev", "diff_first", "d"]
    wanted = fr.frame_changes(table(spark, data), chunk)
    got = fr.frame_changes(as_bytes(spark, data), chunk)
    assert got.columns == wanted.columns
    key = lambda r: r[:2]
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(map(tuple, wanted.select(*columns).collect()), key=key)
    for roi in ((0.25, 0.25, 0.5, 0.75), (0.5, 0.5, 1.0, 1.0)):
        energies = [fr.roi_energies(df, 4, 4, roi, chunk) for df in (table(spark, data), as_bytes(spark, data))]
        assert rows(energies[0], "file_id", "k", "energy") == rows(energies[1], "file_id", "k", "energy")
    verdicts = [rows(fr.prescreen(df, 4.0), "file_id", "status", "checked_pairs") for df in (wanted, got)]
    assert verdicts[0] == verdicts[1]


def test_missing_empty_and_odd_frames(spark):
    data = {"x": [[10] * 4, None, [20] * 4, [30] * 5, [], [50] * 4]}
    unnamed = spark.createDataFrame([(None, 0, b"\x01")], SCHEMA)
    got = fr.frame_changes(as_bytes(spark, data).unionByName(unnamed)).orderBy("i").collect()
    assert [r["luma"] for r in got] == [10.0, None, 20.0, 30.0, None, 50.0]
    assert [r["diff_prev"] for r in got] == [None] * 6
    assert [r["diff_first"] for r in got] == [None, None, 10.0, None, None, 40.0]
    assert fr.frame_changes(as_bytes(spark, {})).count() == 0


def test_pixels_are_shuffled_once_and_cropped_before(spark, tmp_path):
    as_bytes(spark, {"x": [[1] * 16] * 3}).write.parquet(str(tmp_path / "f"))
    frames = spark.read.parquet(str(tmp_path / "f"))
    text = fr.roi_energies(frames, 4, 4)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Window" not in text
    assert "substring" in text.split("Exchange")[1]


def test_detections_reach_the_verdict(spark):
    segments = spark.createDataFrame(
        [("f", s, 10.0 * s, 10.0 * s + 9, "DYNAMIC", 0.0, e) for s, e in [(0, 1.0), (1, 1.0), (2, 50.0), (3, 1.0)]],
        "file_id string, segment_id long, start_time double, end_time double, state string, file_start_offset double, max_energy double",
    )
    pictures = spark.createDataFrame(
        [("f", i, None if i == 32 else bytes([i, 0, 0, 0]), "kept") for i in range(40)],
        "file_id string, frame_idx long, pixels binary, note string",
    )
    doubtful = vf.doubtful_frames(segments, pictures, F.lit(1.0))
    # every second frame of each segment but the energetic one
    assert rows(doubtful, "frame_idx") == [(i,) for i in (*range(0, 20, 2), *range(30, 40, 2))]

    def persons():
        return lambda batch: [[(0, 0.9), (7, 0.2)] if p[0, 0] == 14 else [] for p in batch]

    detected = fr.detect_frames(doubtful, persons, (2, 2), batch_size=3)
    assert detected.columns == ["file_id", "frame_idx", "note", "detections"]
    assert rows(fr.detection_rows(detected), "frame_idx", "class_id", "conf") == [(14, 0, 0.9), (14, 7, 0.2)]
    checked = vf.verify_segments(segments, vf.detected_hits(detected), F.lit(1.0), align="segment")
    # nothing seen; a person; not checked; one frame that could not be judged
    assert rows(checked, "segment_id", "state", "frames_checked") == [(0, "STATIC", 5), (1, "DYNAMIC", 5), (2, "DYNAMIC", 0), (3, "DYNAMIC", 5)]


def test_a_failing_detector(spark):
    frames = as_bytes(spark, {"x": [[n] * 4 for n in range(6)]}).withColumnRenamed("i", "frame_idx").coalesce(1)

    def fails():
        def detect(batch):
            if any(p[0, 0] == 4 for p in batch):
                raise RuntimeError("broken picture")
            return [[] for _ in batch]

        return detect

    with pytest.raises(PythonException, match="broken picture"):
        fr.detect_frames(frames, fails, (2, 2), batch_size=2).collect()
    got = fr.detect_frames(frames, fails, (2, 2), batch_size=2, strict=False)
    assert rows(vf.detected_hits(got), "frame_idx", "hit") == [(i, i in (4, 5)) for i in range(6)]
