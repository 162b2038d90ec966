import random

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from condense.operators import segments as seg, timeline as tl

SCHEMA = (
    "date string, cam_index int, seq long, start_time double, end_time double, state string, source_file string, "
    "file_start_offset double, max_energy double"
)
CHUNKS = [3, 16, 65_536]


def days(seed, cases, overlaps):
    rnd = random.Random(seed)
    out = {}
    for c in range(cases):
        t, parts = 0.0, []
        states = rnd.choice([("STATIC", "DYNAMIC"), ("STATIC", "DYNAMIC"), ("STATIC", "STATIC", "DYNAMIC")])
        for s in range(rnd.randint(1, 30)):
            t = max(0.0, t + rnd.choice([0.0, 0.25, 0.5, 0.75, 3.0] + ([-1.0, -20.0] if overlaps else [])))
            if parts:
                t = max(t, parts[-1]["start_time"])  # starts never fall: the series is in order of start
            end = t + rnd.choice([0.0, 0.5, 1.0, 1.5, 2.0, 5.0, 29.0, 30.0, 31.0, 80.0])
            parts.append(
                {"start_time": t, "end_time": end, "state": rnd.choice(states), "source_file": f"s{s}",
                 "file_start_offset": float(s), "max_energy": float(rnd.randint(0, 9))}
            )
            t = end
        out[f"d{c}"] = parts
    return out


def frame(spark, data):
    rows = [(d, 0, i, *p.values()) for d, parts in data.items() for i, p in enumerate(parts)]
    return spark.createDataFrame(rows, SCHEMA)


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["date"], r["seq"])):
        out.setdefault(r["date"], []).append({c: r[c] for c in seg.SEGMENT_COLUMNS})
    return out


def in_schema_order(parts):
    return [{c: p[c] for c in seg.SEGMENT_COLUMNS} for p in parts]


@pytest.mark.parametrize("chunk", CHUNKS)
@pytest.mark.parametrize("overlaps", [False, True])
def test_merge(spark, chunk, overlaps):
    data = days(1, 250, overlaps)
    got = collected(seg.merge_segments(frame(spark, data), chunk_rows=chunk))
    assert got == {d: in_schema_order(plain.merge(parts, 0.5)) for d, parts in data.items()}


def absorbed_whole(parts):
    """The uncut day by the plain statement of the rule."""
    return in_schema_order(plain.absorb(plain.merge(parts, 0.5), 2.0, 30.0, 0.5))


@pytest.mark.parametrize("chunk", CHUNKS)
@pytest.mark.parametrize("overlaps", [False, True])
def test_absorb_in_chunks_equals_the_uncut_day(spark, chunk, overlaps):
    data = days(2, 400, overlaps)
    got = collected(seg.absorb_short(frame(spark, data), chunk_rows=chunk))
    want = {d: absorbed_whole(parts) for d, parts in data.items()}
    assert {d: v for d, v in got.items() if v != want[d]} == {}
    assert got == want


def test_a_day_of_short_segments_is_folded_in_all_chunks(spark):
    rnd = random.Random(9)
    parts, at = [], 0.0
    for i in range(6_000):
        length = rnd.choice([0.5, 0.25, 1.5, 1.0])
        parts.append(part(at, at + length, "DYNAMIC" if i % 2 else "STATIC", float(i % 17)))
        at += length + (0.75 if i % 50 == 0 else 0.0)
    df = frame(spark, {"d": parts})
    got = collected(seg.absorb_short(df, chunk_rows=100))
    assert got == {"d": absorbed_whole(parts)}
    flagged = seg._flagged(seg.merge_segments(df), seg.DAY, "seq", 2.0, 30.0, F.floor(F.col("seq") / 100).cast("long"))
    assert flagged.groupBy("_chunk").count().agg(F.max("count"), F.count("*")).first()[:] == (100, 60)


def long_day(seed, n):
    """A day that settles in several passes, with short segments, gaps and ends before the end of the one before."""
    rnd, parts, at = random.Random(seed), [], 0.0
    for i in range(n):
        at += rnd.choice([0.25, 0.5, 1.0, 5.0, 20.0, 40.0])
        end = at + rnd.choice([0.1, 1.5, 10.0, 30.0, 60.0, 500.0])
        parts.append(part(at, end, rnd.choice(["STATIC", "DYNAMIC"]), float(rnd.randint(0, 99))) | {"source_file": f"s{i}"})
    return parts


def test_all_passes_of_a_long_day_are_one_job(spark, monkeypatch):
    jobs, write = [], seg.written
    monkeypatch.setattr(seg, "written", lambda df, label: jobs.append(label) or write(df, label))
    data = {"a": long_day(1, 12_000), "b": long_day(2, 9_000), "c": long_day(3, 50)}
    got = collected(seg.absorb_short(frame(spark, data), chunk_rows=3_200))
    assert got == {d: absorbed_whole(parts) for d, parts in data.items()}
    assert jobs == ["settled"]  # a pass wrote two tables, and these days take several


def test_a_day_that_needs_its_neighbours_is_settled_too(spark, monkeypatch):
    jobs, write = [], seg.written
    monkeypatch.setattr(seg, "written", lambda df, label: jobs.append(label) or write(df, label))
    data = {"a": long_day(4, 900)}
    got = collected(seg.absorb_short(frame(spark, data), chunk_rows=40))  # borrows 2 segments: too few
    assert got == {"a": absorbed_whole(data["a"])}
    assert "absorbed" in jobs


def test_more_passes_than_a_job_makes(spark, monkeypatch):
    jobs, write = [], seg.written
    monkeypatch.setattr(seg, "PASSES", 1)
    monkeypatch.setattr(seg, "ship", lambda session: None)
    monkeypatch.setattr(seg, "written", lambda df, label: jobs.append(label) or write(df, label))
    stretches = seg._settle
    monkeypatch.setattr(seg, "_settle", lambda *a: one_pass(stretches(*a)))
    data = {"a": long_day(5, 5_000), "b": long_day(6, 700)}
    got = collected(seg.absorb_short(frame(spark, data), chunk_rows=1_000))
    assert got == {d: absorbed_whole(parts) for d, parts in data.items()}
    assert len(jobs) > 2 and set(jobs) == {"settled"}


def one_pass(settle):
    def run(table):
        seg.PASSES = 1  # in the worker, which imports the module anew
        return settle(table)

    return run


@pytest.mark.parametrize("overlaps", [False, True])
def test_what_a_stretch_knows_is_what_the_whole_day_has(overlaps):
    rnd = random.Random(11)
    for case, parts in days(12, 300, overlaps).items():
        parts = plain.merge(parts, 0.5)
        if len(parts) < 4:
            continue
        lo = rnd.randint(0, len(parts) - 3)
        hi = rnd.randint(lo + 2, len(parts))
        whole, some = stretch(parts, 0, len(parts)), stretch(parts, lo, hi)
        for _ in range(4):
            whole, _, _ = seg._pass(whole, facts(parts), False, False)
            some, beyond, _ = seg._pass(some, facts(parts), lo > 0, hi < len(parts))
            if not len(some[0]):
                break
            known = (whole[0] >= some[0][0]) & (whole[0] < beyond)
            assert [x[known].tolist() for x in whole] == [x.tolist() for x in some], case


def stretch(parts, lo, hi):
    rows = np.arange(lo, hi)
    return rows, rows, rows, np.array([p["max_energy"] for p in parts[lo:hi]])


def facts(parts):
    moves = np.array([p["state"] == "DYNAMIC" for p in parts])
    return {
        "start": np.array([p["start_time"] for p in parts]),
        "end": np.array([p["end_time"] for p in parts]),
        "first_start": parts[0]["start_time"],
        "state": moves.astype(int),
        "moves": moves,
        "least": np.where(moves, 2.0, 30.0),
        "tolerance": 0.5,
    }


def test_absorb_refuses_a_null_in_its_key(spark):
    df = frame(spark, {"d": [part(0.0, 1.0, "STATIC", 1.0), part(1.0, 50.0, "DYNAMIC", 1.0)]})
    with pytest.raises(Exception, match="NULL in its key"):
        seg.absorb_short(df.withColumn("date", F.lit(None).cast("string"))).count()


def part(start, end, state, energy):
    return dict(zip(seg.SEGMENT_COLUMNS, (float(start), float(end), state, "s", 0.0, float(energy))))


def test_absorb_by_hand(spark):
    S, D = "STATIC", "DYNAMIC"
    cases = {
        "alone: kept": ([(0, 1, D, 5)], [(0, 1, D, 5)]),
        "first: into the right one": ([(0, 1, D, 5), (1, 40, S, 1)], [(0, 40, S, 5)]),
        "last: into the left one": ([(0, 40, S, 1), (40, 41, D, 5)], [(0, 41, S, 5)]),
        "between two motions: into the left, which then join": ([(0, 5, D, 1), (5, 10, S, 0), (10, 20, D, 2)], [(0, 20, D, 2)]),
        "equal states too far apart: the short one goes right": (
            [(0, 40, S, 1), (45, 50, S, 2), (50, 60, D, 3)], [(0, 40, S, 1), (45, 60, D, 3)]
        ),
        "the same, and the right one is still too short": ([(0, 40, S, 1), (45, 45.5, S, 2), (45.5, 46, D, 3)], [(0, 46, S, 3)]),
        "exactly the minimum is long enough": (
            [(0, 30, S, 0), (30, 32, D, 1), (32, 62, S, 0)], [(0, 30, S, 0), (30, 32, D, 1), (32, 62, S, 0)]
        ),
    }
    df = frame(spark, {name: [part(*p) for p in parts] for name, (parts, _) in cases.items()})
    for chunk in (1, 2, 65_536):
        got = collected(seg.absorb_short(df, chunk_rows=chunk))
        assert got == {name: [part(*p) for p in parts] for name, (_, parts) in cases.items()}


def test_json_round_trip(spark):
    data = days(3, 5, False)
    df = frame(spark, data)
    stored = seg.segments_to_json(df, ["date"])
    assert stored.count() == len(data)
    back = seg.segments_from_json(stored)
    assert collected(back) == {d: in_schema_order(p) for d, p in data.items()}
    old = spark.createDataFrame(
        [("x", '[{"start_time":0.0,"end_time":1.0,"state":"STATIC","source_file":"a","file_start_offset":0.0}]')],
        "date string, analysis_segments string",
    )
    assert seg.segments_from_json(old).first()["max_energy"] == 0.0


@pytest.mark.parametrize("chunk", CHUNKS)
def test_batches_of_interleaved_files(spark, chunk):
    rnd = random.Random(4)
    rows, want = [], {}
    for d in range(80):
        files = [f"f{rnd.randint(0, 7)}" for _ in range(rnd.randint(1, 40))]
        want[f"d{d}"] = plain.pack(files, 3)
        rows += [(f"d{d}", 0, i, f) for i, f in enumerate(files)]
    df = spark.createDataFrame(rows, "date string, cam_index int, seq long, filepath string")
    got = {}
    for r in sorted(tl.batches(df, 3, chunk).collect(), key=lambda r: (r["date"], r["seq"])):
        got.setdefault(r["date"], []).append(r["batch_idx"])
    assert got == want


def test_order_of_equal_starts_and_midnight(spark):
    clips = spark.createDataFrame(
        [
            ("/b.mp4", "20240101", 0, "20240101235900", "20240102000100", "STATIC"),
            ("/a.mp4", "20240101", 0, "20240101000000", "20240101000100", "STATIC"),
        ],
        "path string, date string, cam_index int, file_start_time string, file_end_time string, prescreen_status string",
    )
    static = tl.static_segments(clips)
    ordered = tl.in_order(static).orderBy("seq").collect()
    assert [(r["source_file"], r["start_time"], r["end_time"]) for r in ordered] == [
        ("/a.mp4", 0.0, 60.0),
        ("/b.mp4", 86340.0, 86460.0),
    ]
    same = static.withColumn("start_time", F.lit(5.0))
    assert [r["source_file"] for r in tl.in_order(same).orderBy("seq").collect()] == ["/a.mp4", "/b.mp4"]


def test_edit_list_lengths(spark):
    rows = [
        ("d", 0, 0, "/a", 0.0, 10.0, "DYNAMIC", 10.0),
        ("d", 0, 1, "/a", 10.0, 10.5, "STATIC", 0.5),
        ("d", 0, 2, "/b", 0.0, 600.0, "STATIC", 600.0),
        ("d", 0, 3, "/b", 0.0, 0.0, "STATIC", 0.0),
    ]
    timeline = spark.createDataFrame(
        rows,
        "date string, cam_index int, seq long, filepath string, start_in_file double, end_in_file double, state string, duration double",
    )
    clips = spark.createDataFrame([("/a", True), ("/b", None)], "path string, has_audio boolean")
    for chunk in (2, 65_536):
        got = tl.edit_list(timeline, clips, chunk_rows=chunk).orderBy("seq").collect()
        assert [r["shown"] for r in got] == [10.0, 0.5, 10.0, 0.0]
        assert [r["speed"] for r in got] == [1.0, 1.0, 60.0, 1.0]
        assert [r["audio"] for r in got] == ["SOURCE", "SILENT", "SILENT", "SILENT"]
        assert [r["output_start"] for r in got] == [0.0, 10.0, 10.5, 20.5]
