import datetime as dt

from pyspark.sql import functions as F

from condense.functions import clock, sampling
from condense.functions.names import output_name
from condense.operators import registry as reg
from condense.sources import listing as ls, tables

NOW = dt.datetime(2026, 3, 20, 12, 0, 0)


def found(spark, rows):
    return spark.createDataFrame(
        [(p, NOW - dt.timedelta(minutes=age), n) for p, age, n in rows], "path string, modificationTime timestamp, length long"
    )


def test_names(spark):
    rows = [
        ("/in/00_20260320100000_20260320100500.mp4", 60.0, 1),
        ("/in/01_20261320100000_20261320100500.mp4", 60.0, 1),  # month 13
        ("/in/notes.mp4", 60.0, 1),
        ("/in/00_20260320100000_20260320100500.MP4", 60.0, 1),
        ("/in/x00_20260320100000_20260320100500.mp4", 60.0, 1),
        ("/in/02_20260319235900_20260320000100.mp4", 60.0, 1),
    ]
    got = {r["path"]: r for r in ls.clip_names(found(spark, rows)).collect()}
    assert len(got) == 3
    clip = got[rows[0][0]]
    assert (clip["cam_index"], clip["date"], clip["file_duration"]) == (0, "20260320", 300.0)
    assert got[rows[1][0]]["file_duration"] is None
    assert got[rows[5][0]]["date"] == "20260319" and got[rows[5][0]]["file_duration"] == 120.0


def test_gates(spark):
    name = "/in/{:02d}_20260320100000_20260320100500.mp4"
    ages = [9.99, 10.0, 14.99, 14.98, 15.0, 14.97]
    first = found(spark, [(name.format(i), age, 100) for i, age in enumerate(ages)])
    sizes = {1: 100, 2: 101, 4: 999, 5: 100}  # 3 is gone, 2 has grown, 4 is too old to be looked at again
    second = spark.createDataFrame([(name.format(i), n) for i, n in sizes.items()], "path string, length long")
    as_of = F.lit(NOW)
    judged = ls.classify(ls.clip_names(first), as_of, second).orderBy("path").collect()
    assert [r["intake"] for r in judged] == ["frozen", "added", "frozen", "frozen", "added", "added"]
    none = ls.classify(ls.clip_names(first), as_of, second, freeze_minutes=0).collect()
    assert {r["intake"] for r in none} == {"added"}
    today = ls.classify(ls.clip_names(first), as_of, second, skip_today=True).collect()
    assert {r["intake"] for r in today} == {"skipped"}


def test_low_bitrate(spark):
    # 300 s: 37,500 bytes per kbps
    rows = [("/in/00_20260320100000_20260320100500.mp4", 60.0, 37_500 * 99), ("/in/01_20260320100000_20260320100500.mp4", 60.0, 37_500 * 100)]
    rows.append(("/in/02_20260320100000_20260320100000.mp4", 60.0, 1))  # no duration: no bitrate verdict
    judged = ls.classify(ls.clip_names(found(spark, rows)), F.lit(NOW), min_kbps=100.0).orderBy("path").collect()
    assert [r["prescreen_status"] for r in judged] == ["STATIC", "PENDING", "PENDING"]
    assert judged[0]["prescreen_result"] == '{"reason":"low_bitrate","kbps":99.0}'


def test_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "00_20260320100000_20260320100500.mp4").write_bytes(b"x" * 7)
    (tmp_path / "other.txt").write_bytes(b"y")
    df = ls.list_files(spark, str(tmp_path))
    assert [r["length"] for r in df.collect()] == [7]
    assert "content:binary" not in df._jdf.queryExecution().executedPlan().toString()


def clip_rows(spark, rows):
    return spark.createDataFrame(
        rows, "path string, date string, cam_index int, file_start_time string, prescreen_status string, analysis_status string"
    )


CLIPS = [
    ("/a", "20260101", 0, "20260101000100", "PENDING", "PENDING"),
    ("/b", "20260101", 0, "20260101000000", "SUSPICIOUS", "PENDING"),
    ("/c", "20260101", 1, "20260101000000", "SUSPICIOUS", "ANALYZED"),
    ("/d", "20260102", 0, "20260102000000", "STATIC", "PENDING"),
    ("/e", "20260102", 0, "20260102000100", "FAILED", "PENDING"),
]


def test_registry(spark):
    clips = clip_rows(spark, CLIPS)
    assert [r["path"] for r in reg.in_clip_order(reg.of_day(clips, "20260101")).collect()] == ["/b", "/a"]
    counts = {(r["date"], r["cam_index"]): r for r in reg.pending_counts(clips).collect()}
    assert counts["20260101", 0]["pending"] == 2 and not counts["20260101", 0]["prescreen_complete"]
    assert counts["20260101", 1]["pending"] == 0 and counts["20260101", 1]["analysis_complete"]
    routes = {r["path"]: r["route"] for r in reg.route(clips).collect()}
    assert routes == {"/a": "prescreen", "/b": "analysis", "/c": "timeline", "/d": "timeline", "/e": "failed"}
    assert {r["path"] for r in reg.prescreen_pending(clips, retry_failed=True).collect()} == {"/a", "/e"}
    more = clip_rows(spark, [CLIPS[0], ("/f", "20260103", 0, "1", "PENDING", "PENDING"), ("/f", "20260103", 0, "1", "PENDING", "PENDING")])
    assert reg.insert_new(clips, more).count() == 6
    change = spark.createDataFrame([("/a", "STATIC", None), ("/zz", "STATIC", None)], "path string, prescreen_status string, analysis_status string")
    updated = {r["path"]: r for r in reg.update(clips, change).collect()}
    assert len(updated) == 5 and updated["/a"]["prescreen_status"] == "STATIC" and updated["/a"]["analysis_status"] == "PENDING"


def test_day_status(spark):
    schema = "date string, cam_index int, status string, updated_at int"
    old = spark.createDataFrame([("d1", 0, "COMPLETED", 1), ("d2", 0, "PENDING", 1)], schema)
    new = spark.createDataFrame([("d2", 0, "FAILED", 2), ("d3", 0, "RENDERING", 2)], schema)
    status = reg.upsert(old, new)
    assert {(r["date"], r["status"]) for r in status.collect()} == {("d1", "COMPLETED"), ("d2", "FAILED"), ("d3", "RENDERING")}
    assert tuple(reg.run_outcome(status).first()) == (3, 1, 1, 1)
    counts = spark.createDataFrame([("d1", 0, 0), ("d2", 0, 0), ("d4", 0, 3)], "date string, cam_index int, pending int")
    actions = {r["date"]: r["action"] for r in reg.day_actions(counts, status).collect()}
    assert actions == {"d1": "skip", "d2": "run", "d4": "run"}
    again = reg.day_actions(counts.withColumn("pending", F.lit(1)), status)
    assert {r["date"]: r["action"] for r in again.collect()}["d1"] == "reopen"


def test_day_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    clips = clip_rows(spark, CLIPS)
    tables.write_days(clips, path)
    one = tables.read_days(spark, path, clips.schema, "20260102")
    assert one.count() == 2
    assert "PartitionFilters: [isnotnull(date" in one._jdf.queryExecution().executedPlan().toString()
    tables.write_days(clips.where("path = '/d'"), path, "overwrite")  # replaces that day only
    assert tables.read_days(spark, path, clips.schema).count() == 4


def test_label_files(spark, tmp_path):
    labels = spark.createDataFrame(
        [(1, 0, 0.0, False), (1, 1, 65.254, True), (2, 3, 3599.999, True)], "file_id long, i long, time double, is_motion boolean"
    )
    tables.write_label_csv(labels, str(tmp_path / "one"))
    rows = spark.read.schema(tables.LABEL_CSV).option("header", True).csv(str(tmp_path / "one")).orderBy("file_id").collect()
    assert [tuple(r) for r in rows] == [(1, "65.25", 1, "1:05.25", 1), (3, "3600.00", 1, "59:60.00", 2)]
    tables.write_label_csv(labels, str(tmp_path / "many"), per_file=True)
    assert spark.read.schema(tables.LABEL_CSV).option("header", True).csv(str(tmp_path / "many")).count() == 2


def test_scalars(spark):
    row = spark.range(1).select(
        clock.stamp_to_epoch(F.lit("20240229000000")).alias("leap"),
        clock.stamp_to_epoch(F.lit("20230229000000")).alias("none"),
        clock.day_offset(F.lit("20240102000130"), F.lit("20240101")).alias("over"),
        clock.day_offset(F.lit("20231231235900"), F.lit("20240101"), clamp=True).alias("clamped"),
        sampling.known_duration(F.lit(0.0)).alias("zero"),
        sampling.seek_points(F.lit(1.0), 5).alias("short"),
        sampling.seek_points(F.lit(1.01), 2).alias("points"),
        output_name(F.lit("20240101"), F.lit(3)).alias("name"),
    ).first()
    assert row["leap"] == 1709164800.0 and row["none"] is None
    assert row["over"] == 86490.0 and row["clamped"] == 0.0 and row["zero"] == 300.0
    assert row["short"] == [0.0] and row["points"] == [0.0, 0.505, 0.51]
    assert row["name"] == "DailyVlog_20240101_cam3.mp4"
