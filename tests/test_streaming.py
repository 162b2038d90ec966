"""Streams against their batch form, with shuffled splits, restarts and late clips."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from condense.operators import frames as fr, segments as seg, timeline as tl
from condense.sources.tables import read_days
from condense.streaming import folds, jobs, release, settle

NOW = dt.datetime(2026, 3, 20, 12, 0, 0)


def split_stream(spark, df, path, splits, seed=0):
    """Write the rows of ``df`` shuffled into files that arrive one after another."""
    rows = df.collect()
    random.Random(seed).shuffle(rows)
    for s in range(splits):
        spark.createDataFrame(rows[s::splits], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, stream, path):
    jobs.to_table(stream, f"{path}/out", f"{path}/checkpoint").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def rows_of(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def test_prescreen(spark, tmp_path):
    rnd = random.Random(1)
    rows = []
    for f in range(12):
        n = rnd.randint(1, 9)
        rows += [(f"c{f}", i, n, [rnd.randint(40, 60) for _ in range(8)]) for i in range(n)]
    frames = spark.createDataFrame(rows, "file_id string, i long, frames long, pixels array<int>")
    stream = split_stream(spark, frames, f"{tmp_path}/in", 4)
    got = run(spark, folds.prescreen_stream(stream, 7.0), str(tmp_path))
    want = fr.prescreen(fr.frame_changes(frames, 2), 7.0, "stream_fps").select(got.columns)
    assert repr(rows_of(got)) == repr(rows_of(want))


START = dt.datetime(2026, 1, 1)
SEGMENTS = (
    "date string, cam_index int, event_time timestamp, start_time double, end_time double, state string, source_file string, "
    "file_start_time string, seq_in_file long, file_start_offset double, max_energy double"
)


def segments_of(days, seed, longest=15):
    rnd, rows = random.Random(seed), []
    for d in range(days):
        t = 0.0
        for n in range(rnd.randint(1, longest)):
            t += rnd.choice([0.0, 0.5, 2.0])
            at = START + dt.timedelta(days=d, seconds=t)
            rows.append((f"2026010{d + 1}", 0, at, t, t + 1, rnd.choice(["STATIC", "DYNAMIC"]), f"s{n // 4}", f"{n // 4}", n, 0.0, float(n)))
            t += 1
    return rows


def later(row, days):
    return ("99991231", 0, START + dt.timedelta(days=days), *row[3:])


def arrive(spark, path, schema, *parts):
    """One file per part, one after another."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def merged(spark, rows):
    ordered = tl.in_order(spark.createDataFrame(rows, SEGMENTS))
    return seg.merge_segments(ordered, chunk_rows=3)


def test_merge_of_late_missing_and_repeated_rows(spark, tmp_path):
    rows = segments_of(6, 2)
    missing = rows.pop(len(rows) // 2)
    assert missing not in rows
    shuffled = rows[:]
    random.Random(5).shuffle(shuffled)
    first, second = shuffled[::2], shuffled[1::2] + shuffled[:6:2]  # within the delay in any order, three of them twice
    close = [later(rows[0], 40)]
    too_late = [rows[0], *segments_of(1, 77)[:1]]  # of a day long closed: a copy and a new one
    stream = arrive(spark, f"{tmp_path}/in", SEGMENTS, first, second, close, too_late, [later(rows[0], 80)])
    got = run(spark, release.merge_stream(stream, delay="10 days"), str(tmp_path))
    want = merged(spark, rows).unionByName(merged(spark, close))
    assert rows_of(got) == rows_of(want.select(got.columns))


def test_merge_gives_out_as_soon_as_nothing_can_join_and_survives_restarts(spark, tmp_path):
    path = str(tmp_path)
    rows = segments_of(2, 9)
    days = [[r for r in rows if r[0] == d] for d in ("20260101", "20260102")]
    seen = []
    for part in (days[0], days[1], [later(rows[0], 40)]):
        stream = arrive(spark, f"{path}/in", SEGMENTS, part)
        got = run(spark, release.merge_stream(stream, delay="1 hour"), path)
        seen.append(got.count())
    assert seen[1] == merged(spark, days[0]).count() <= seen[2] == merged(spark, rows).count()
    assert 0 <= seen[0] < seen[1]
    assert rows_of(got) == rows_of(merged(spark, rows).select(got.columns))


CLIPS = "date string, cam_index int, path string, done_at timestamp"


def test_batches_are_filled_and_the_rest_flushed(spark, tmp_path):
    rows = [(f"d{d}", 0, f"/{d}/{p}", START + dt.timedelta(hours=p, minutes=d)) for d, n in enumerate([1, 4, 9]) for p in range(n)]
    shuffled = rows[:]
    random.Random(4).shuffle(shuffled)
    end = lambda days: ("z", 0, "/end", START + dt.timedelta(days=days))
    stream = arrive(spark, f"{tmp_path}/in", CLIPS, shuffled[::2], shuffled[1::2] + shuffled[:2], [end(3)], [end(30)])
    got = run(spark, release.batch_stream(stream, delay="1 day", per_batch=4, patience_hours=30), str(tmp_path))
    ordered = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], CLIPS + ", pos long")
    want = tl.batches_by_completion(ordered, ["pos"], 4).select(got.columns)
    assert rows_of(got.where("date <> 'z'")) == rows_of(want)


def test_a_clip_after_the_patience_opens_a_batch_of_its_own(spark, tmp_path):
    at = lambda hours: START + dt.timedelta(hours=hours)
    rows = [("d", 0, f"/{h}", at(h)) for h in (0, 1, 60, 61)]
    stream = arrive(spark, f"{tmp_path}/in", CLIPS, rows[:2], [("z", 0, "/z", at(50))], rows[2:], [("z", 0, "/y", at(400))])
    got = run(spark, release.batch_stream(stream, delay="1 hour", per_batch=4, patience_hours=24), str(tmp_path))
    assert {r["path"]: r["batch_idx"] for r in got.where("date = 'd'").collect()} == {"/0": 0, "/1": 0, "/60": 1, "/61": 1}


def intake(spark, path):
    listings = spark.readStream.schema("path string, modificationTime timestamp, length long").option(
        "maxFilesPerTrigger", 1
    ).parquet(f"{path}/in")
    moment = lambda n: F.lit(NOW + dt.timedelta(minutes=10 * n))
    return jobs.intake_job(listings, f"{path}/registry", f"{path}/held", f"{path}/checkpoint", moment)


def test_intake_holds_young_clips_and_survives_a_restart(spark, tmp_path):
    path = str(tmp_path)
    name = "/in/{:02d}_20260320100000_20260320100500.mp4"

    def arrive(*rows):
        made = [(name.format(c), NOW - dt.timedelta(minutes=age), size) for c, age, size in rows]
        spark.createDataFrame(made, "path string, modificationTime timestamp, length long").coalesce(1).write.mode("append").parquet(
            f"{path}/in"
        )

    def registered():
        df = spark.read.parquet(f"{path}/registry")
        return sorted((r["path"], r["batch"]) for r in df.select("path", "batch").collect())

    arrive((0, 60, 5), (1, 3, 5))
    intake(spark, path).start().awaitTermination()
    assert registered() == [(name.format(0), 0)]
    arrive((0, 60, 5), (2, 60, 5))  # a known clip again; the held one has settled meanwhile
    intake(spark, path).start().awaitTermination()
    assert registered() == [(name.format(0), 0), (name.format(1), 1), (name.format(2), 1)]
    intake(spark, path).start().awaitTermination()  # nothing new
    assert len(registered()) == 3


def test_duplicates_are_let_through_once(spark, tmp_path):
    rows = [(f"/c{i % 5}", NOW + dt.timedelta(seconds=i)) for i in range(30)]
    seen = spark.createDataFrame(rows, "path string, seen_at timestamp")
    stream = split_stream(spark, seen, f"{tmp_path}/in", 3)
    got = run(spark, jobs.without_duplicates(stream, ["path"], "seen_at", "1 hour"), str(tmp_path))
    assert sorted(r["path"] for r in got.collect()) == [f"/c{i}" for i in range(5)]


def test_reopened_days(spark, tmp_path):
    path = str(tmp_path)
    schema = (
        "date string, cam_index int, start_time double, file_start_time string, source_file string, seq_in_file long, "
        "end_time double, state string, file_start_offset double, max_energy double"
    )
    part = lambda day, t, n: (day, 0, t, f"{day}000000", f"/{day}", n, t + 50.0, "STATIC" if n % 2 else "DYNAMIC", 0.0, 1.0)
    first = spark.createDataFrame([part("20260101", 0.0, 0), part("20260102", 0.0, 0)], schema)
    later = spark.createDataFrame([part("20260101", 60.0, 1)], schema)
    first.coalesce(1).write.parquet(f"{path}/in")
    timeline = "date string, cam_index int, seq long, filepath string, start_in_file double, end_in_file double, state string, duration double"

    def rebuild():
        stream = spark.readStream.schema(schema).parquet(f"{path}/in")
        jobs.reopen_job(stream, f"{path}/store", f"{path}/timelines", f"{path}/checkpoint", first.schema).start().awaitTermination()
        return {(r["date"], r["seq"], r["state"]) for r in read_days(spark, f"{path}/timelines", timeline).collect()}

    assert rebuild() == {("20260101", 0, "DYNAMIC"), ("20260102", 0, "DYNAMIC")}
    later.coalesce(1).write.mode("append").parquet(f"{path}/in")
    assert rebuild() == {("20260101", 0, "DYNAMIC"), ("20260101", 1, "STATIC"), ("20260102", 0, "DYNAMIC")}


def test_a_stage_stopped_in_a_batch_decides_every_key_once(spark, tmp_path):
    path = str(tmp_path)
    schema = "path string, n long"

    def go(fail=False):
        def work(new):
            if fail:
                raise RuntimeError("stopped")
            return new.withColumn("verdict", F.col("n") % 2)

        stream = jobs.changes_of(spark, f"{path}/in", schema)
        query = jobs.stage_job(stream, f"{path}/out", f"{path}/checkpoint", ["path"], work).start()
        try:
            query.awaitTermination()
        except Exception:  # noqa: BLE001
            assert fail

    def arrive_as(batch, *rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/in/batch={batch}")

    arrive_as(0, ("/a", 1), ("/b", 2))
    go()
    arrive_as(0, ("/a", 1), ("/b", 2))  # the stage before tries its batch again under other file names
    arrive_as(1, ("/c", 3))
    go(fail=True)
    go()
    go()
    rows = spark.read.parquet(f"{path}/out").collect()
    assert sorted((r["path"], r["verdict"]) for r in rows) == [("/a", 1), ("/b", 0), ("/c", 1)]


SIGHTS = "path string, modificationTime timestamp, length long, seen_at timestamp"


def test_paths_of_one_state_are_judged_apart(spark, tmp_path):
    path, at = str(tmp_path), lambda m: START + dt.timedelta(minutes=m)
    files = [(f"/{n}", START - dt.timedelta(minutes=n), n, at(0)) for n in range(30)]
    more = [("/3", at(-3), 3, at(1)), ("/5", at(-5), None, at(1)), ("/12", at(-12), 12, at(1)), ("/7", at(1), 8, at(1))]
    sights = arrive(spark, f"{path}/in", SIGHTS, files, more, [(None, None, None, at(40))], [(None, None, None, at(41))])
    got = run(spark, settle.settled_stream(sights, blocks=1), path).collect()
    want = {f"/{n}": (n, max(0, 15 - n)) for n in range(30) if n != 5} | {"/12": (12, 1), "/7": (8, 16)}
    assert {r["path"]: (r["length"], (r["settled_at"] - START).total_seconds() / 60) for r in got} == want and len(got) == 29


def test_growing_vanished_and_settled_files_are_judged_without_news(spark, tmp_path):
    path = str(tmp_path)
    born = START - dt.timedelta(minutes=11)
    at = lambda m: START + dt.timedelta(minutes=m)
    old = ("/old", START - dt.timedelta(hours=2), 5, at(0))
    first = [old, *[(p, born, 5, at(0)) for p in ("/grows", "/gone", "/settles", "/quiet")], ("/young", at(-1), 5, at(0))]
    second = [old[:3] + (at(1),), ("/grows", at(1), 9, at(1)), ("/gone", born, None, at(1)), ("/settles", born, 5, at(1))]
    empty = lambda m: [(None, None, None, at(m))]

    def passed(*part):
        got = run(spark, settle.settled_stream(arrive(spark, f"{path}/in", SIGHTS, *part)), path)
        return {r["path"]: (r["length"], (r["settled_at"] - START).total_seconds() / 60) for r in got.collect()}, got.count()

    assert passed(first)[0] == {"/old": (5, 0)}
    settled = {"/old": (5, 0), "/settles": (5, 1)}
    assert passed(second)[0] == settled
    # restarted, and with scans that see nothing: timers judge what is held
    assert passed(empty(6))[0] == settled | {"/quiet": (5, 4)}
    got, n = passed(empty(40), [("/old", old[1], 5, at(41))])
    assert got == settled | {"/quiet": (5, 4), "/young": (5, 14), "/grows": (9, 16)} and n == 5
