import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from condense.functions import pixels as px
from condense.operators import frames as fr, metrics as mt, verify as vf


def clips(seed=1, n=40):
    rnd = random.Random(seed)
    out = {}
    for c in range(n):
        base, spread = rnd.choice([30, 49, 50, 51, 120]), rnd.choice([1, 3, 9])
        out[f"c{c}"] = [[max(0, min(255, base + rnd.randint(-spread, spread))) for _ in range(16)] for _ in range(rnd.randint(1, 14))]
    return out


def table(spark, data):
    rows = [(f, i, p) for f, ps in data.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "file_id string, i long, pixels array<int>")


def verdict(frames, base, mode):
    limit = lambda p: max(1.5, base * 0.3) if np.mean(p) < 50 else base
    seen = []
    for i in range(1, len(frames)):
        d = max(np.abs(np.subtract(frames[i], frames[i - 1])).mean(), np.abs(np.subtract(frames[i], frames[0])).mean())
        seen.append(d)
        if d > limit(frames[i]):
            return "SUSPICIOUS", len(seen), True
    if not seen:
        return "FAILED", 0, False
    final = limit(frames[-1]) if mode == "legacy_seek" else base
    return ("SUSPICIOUS" if max(seen) > final else "STATIC"), len(seen), False


@pytest.mark.parametrize("chunk", [2, 5, 1024])
@pytest.mark.parametrize("mode", ["legacy_seek", "stream_fps"])
def test_verdicts(spark, chunk, mode):
    data = clips()
    data["dark_end"] = [[100] * 16, [104] * 16, [101] * 16, [102] * 16]
    changes = fr.frame_changes(table(spark, data), chunk)
    got = {r["file_id"]: (r["status"], r["checked_pairs"], r["early_stop"]) for r in fr.prescreen(changes, 4.0, mode).collect()}
    assert got == {f: verdict(ps, 4.0, mode) for f, ps in data.items()}


def test_dark_last_frame_counts_only_when_seeking(spark):
    # a change below the bright threshold, then a dark picture with a small change
    data = {"x": [[52] * 16, [56] * 16, [49] * 16]}
    changes = fr.frame_changes(table(spark, data)).withColumn("d", F.when(F.col("i") == 2, 1.0).otherwise(F.col("d")))
    modes = {m: fr.prescreen(changes, 5.0, m).first()["status"] for m in ("legacy_seek", "stream_fps")}
    assert modes == {"legacy_seek": "SUSPICIOUS", "stream_fps": "STATIC"}


def test_difference_equal_to_the_threshold_is_not_exceeded(spark):
    changes = fr.frame_changes(table(spark, {"x": [[100] * 16, [104] * 16]}))
    assert fr.prescreen(changes, 4.0).first()["status"] == "STATIC"


@pytest.mark.parametrize("chunk", [3, 1024])
def test_roi_energy_and_kernels(spark, chunk):
    data = clips(2, 10)
    roi = (0.25, 0.25, 0.5, 0.75)
    box = px.roi_box(4, 4, roi)
    got = {(r["file_id"], r["k"]): r["energy"] for r in fr.roi_energies(table(spark, data), 4, 4, roi, chunk).collect()}
    for f, ps in data.items():
        for k in range(len(ps) - 1):
            a, b = (np.array(ps[j]).reshape(4, 4)[1:4, 1:3] for j in (k, k + 1))
            assert got[f, k] == np.abs(a - b).sum() / 6
    raw = spark.createDataFrame([(bytes(p), bytes(q)) for p, q in zip(data["c0"], data["c1"])], "a binary, b binary")
    row = raw.select(px.luma_binary("a"), px.mean_abs_diff_binary("a", "b"), px.roi_energy_binary(4, 4, box)("a", "b")).first()
    a, b = np.array(data["c0"][0], float), np.array(data["c1"][0], float)
    assert row[0] == a.mean() and row[1] == np.abs(a - b).mean()
    assert row[2] == np.abs(a.reshape(4, 4) - b.reshape(4, 4))[1:4, 1:3].sum() / 6


def test_roi_wider_than_the_picture_keeps_the_nominal_area(spark):
    data = {"x": [[0] * 16, [8] * 16]}
    assert fr.roi_energies(table(spark, data), 4, 4, (0.5, 0.5, 1.0, 1.0)).first()["energy"] == 8 * 4 / 16


def test_sampled_detail(spark):
    data = {"calm": [[100 + i % 2] * 16 for i in range(30)], "busy": [[100] * 16] * 20 + [[200] * 16] * 10}
    frames = table(spark, data).withColumn("offset_s", F.col("i") * 1.0)
    files = spark.createDataFrame([("calm", 30.0), ("busy", 30.0)], "file_id string, duration double")
    samples = fr.sample_stream(frames, files, 10)
    detail = {r["file_id"]: r for r in fr.prescreen_detail(fr.frame_changes(samples), samples, files, 6.0, segments=10).collect()}
    assert detail["calm"]["prescreen_status"] == "STATIC" and detail["busy"]["prescreen_status"] == "SUSPICIOUS"
    calm = json.loads(detail["calm"]["prescreen_result"])
    assert calm["sample_ts"] == [3.0 * i for i in range(11)] and "mean_luma" not in calm and len(calm["diffs"]) == 10
    busy = json.loads(detail["busy"]["prescreen_result"])
    assert busy["early_stop"] and busy["max_diff"] == 100.0 and busy["mean_luma"] == 200.0
    stored = spark.createDataFrame([(json.dumps(busy),), ("{broken",), ("{}",)], "prescreen_result string")
    assert [tuple(r)[1:] for r in fr.read_detail(stored).collect()] == [(100.0, len(busy["sample_ts"])), (None, None), (0.0, 0)]


def segment_table(spark, rows):
    return spark.createDataFrame(
        rows, "file_id string, segment_id long, start_time double, end_time double, state string, file_start_offset double, max_energy double"
    )


@pytest.mark.parametrize("block", [4, 4096])
def test_verification(spark, block):
    D = "DYNAMIC"
    segments = segment_table(spark, [
        ("f", 0, 100.0, 110.0, D, 100.0, 1.0),  # target in range
        ("f", 1, 120.0, 125.0, D, 100.0, 1.0),  # frames, other classes only
        ("f", 2, 150.0, 151.0, D, 100.0, 1.0),  # no sampled frame
        ("f", 3, 120.0, 125.0, D, 100.0, 12.0),  # energy at the limit
        ("f", 4, 120.0, 120.0, D, 100.0, 1.0),  # no length
        ("f", 5, 120.0, 125.0, "STATIC", 100.0, 1.0),
    ])
    frames = spark.createDataFrame([("f", i) for i in (0, 10, 20, 22, 25)], "file_id string, frame_idx long")
    detections = spark.createDataFrame(
        [("f", 10, 0, 0.3), ("f", 20, 7, 0.9), ("f", 22, 0, 0.29), ("f", 10, 0, 0.9)], "file_id string, frame_idx long, class_id int, conf double"
    )
    hits = vf.sampled_hits(frames, detections)
    got = {r["segment_id"]: r for r in vf.verify_segments(segments, hits, F.lit(1.0)).collect()}
    assert [got[i]["state"] for i in range(6)] == [D, "STATIC", D, D, D, "STATIC"]
    assert [got[i]["frames_checked"] for i in range(3)] == [2, 3, 0]
    aligned = vf.segment_frames(segments.where("segment_id = 1"), hits, F.lit(1.0), 0.5, "segment", block)
    assert sorted(r["frame_idx"] for r in aligned.collect()) == [20, 22]
    report = vf.verify_report(vf.verify_segments(segments, hits, F.lit(1.0))).first()
    assert (report["segments_before"], report["segments_after"], report["flipped"]) == (6, 6, 1)


def test_latency_ranks(spark):
    rows = [("one", 2.5)] + [("twenty", float(d)) for d in range(1, 21)]
    got = {r["stage"]: r for r in mt.stage_latency(spark.createDataFrame(rows, "stage string, duration double")).collect()}
    assert (got["one"]["p50"], got["one"]["p95"], got["one"]["count"]) == (2.5, 2.5, 1)
    assert (got["twenty"]["p50"], got["twenty"]["p95"], got["twenty"]["total"]) == (11.0, 20.0, 210.0)


def test_stage_resources(spark):
    stages = spark.createDataFrame([("h", "a", 0.0, 10.0), ("h", "idle", 5000.0, 6000.0)], "host string, name string, start_ts double, end_ts double")
    samples = spark.createDataFrame(
        [("h", 0.0, "gpu0", "load", 10.0), ("h", 10.0, "gpu0", "load", 30.0), ("h", 10.01, "gpu0", "load", 99.0), ("h", 5.0, "gpu0", "mem", 7.0)],
        "host string, ts double, device string, metric string, value double",
    )
    got = {r["name"]: r for r in mt.stage_resources(stages, samples, ["host"], ["load"], ["mem"], slot=3.0).collect()}
    assert (got["a"]["avg_load"], got["a"]["peak_mem"], got["a"]["duration"]) == (20.0, 7.0, 10.0)
    assert (got["idle"]["avg_load"], got["idle"]["peak_mem"]) == (0.0, 0.0)
    assert mt.total_duration(stages).first()[0] == 1010.0


def test_later_map_wins(spark):
    row = spark.range(1).select(mt.merge_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2"))).alias("m")).first()
    assert row["m"] == {"a": "2", "b": "1"}
