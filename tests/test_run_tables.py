"""Run documents, and updates that touch only the days they change."""

import json
import os

import pytest

from condense.operators import metrics as mt
from condense.sources.tables import in_days, read_days, update_days, write_days, write_run_documents

DAY = ["date", "cam_index"]


def test_a_document_per_run(spark, tmp_path):
    stages = spark.createDataFrame(
        [("d1", 0, "scan", 0.0, 10.0), ("d1", 0, "render", 10.0, 30.555), ("d2", 1, "scan", 5.0, 6.0)],
        "date string, cam_index int, name string, start_ts double, end_ts double",
    )
    samples = spark.createDataFrame(
        [("d1", 0, 1.0, "gpu0", "load", 10.0), ("d1", 0, 2.0, "gpu0", "load", 10.5), ("d1", 0, 3.0, "gpu1", "mem", 7.0)],
        "date string, cam_index int, ts double, device string, metric string, value double",
    )
    records = spark.createDataFrame(
        [("d1", 0, "scan", float(d)) for d in range(1, 21)], "date string, cam_index int, stage string, duration double"
    )
    documents = mt.run_documents(records, stages, samples, DAY, ["load"], ["mem"], "/records", slot=3.0)
    path = str(tmp_path / "runs")
    write_run_documents(documents, path)
    texts = [line for f in sorted(os.listdir(path)) if f.endswith(".json") for line in open(os.path.join(path, f))]
    first, second = sorted(map(json.loads, texts), key=lambda d: d["date"])
    assert first["pipeline_duration"] == 30.56 and first["records"] == {"path": "/records", "count": 20}
    assert first["monitor_summary"] == [
        {"name": "render", "duration": 20.56, "devices": {}},
        {"name": "scan", "duration": 10.0, "devices": {"gpu0": {"avg_load": 10.2, "peak_mem": 0.0}, "gpu1": {"avg_load": 0.0, "peak_mem": 7.0}}},
    ]
    assert first["perf_summary"]["scan"] == {"count": 20, "total": 210.0, "avg": 10.5, "p50": 11.0, "p95": 20.0, "min": 1.0, "max": 20.0}
    # a run without samples and records
    assert second["records"]["count"] == 0 and "perf_summary" not in second and second["monitor_summary"][0]["devices"] == {}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        write_run_documents(documents, path)


def files(path):
    return {os.path.join(folder, n): os.stat(os.path.join(folder, n)).st_mtime_ns for folder, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_only_touched_days_are_read_and_written(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "date string, cam_index int, path string, status string, note string"
    rows = [(f"2024010{d}", c, f"/{d}/{c}/{n}", "PENDING", None) for d in range(1, 6) for c in (0, 1) for n in range(3)]
    write_days(spark.createDataFrame(rows, schema), path)
    before = files(path)
    changes = spark.createDataFrame(
        [
            ("20240102", 1, "/2/1/0", "STATIC"),
            ("20240102", 1, "/2/1/1", None),  # leaves the old value
            ("20240104", 0, "/4/0/2", "SUSPICIOUS"),
            ("20240104", 0, "/unknown", "STATIC"),
            ("20240109", 0, "/9/0/0", "STATIC"),  # a day that is not there
            (None, 0, "/1/0/0", "STATIC"),
        ],
        "date string, cam_index int, path string, status string",
    )
    assert update_days(spark, path, schema, changes) == 2
    after = files(path)
    kept = {f: t for f, t in before.items() if not ("20240102" in f and "cam_index=1" in f or "20240104" in f and "cam_index=0" in f)}
    assert len(kept) == 8 and kept.items() <= after.items() and not (before.keys() - kept.keys()) & after.keys()
    wanted = {r[2]: r[3] for r in rows} | {"/2/1/0": "STATIC", "/4/0/2": "SUSPICIOUS"}
    assert {r["path"]: r["status"] for r in read_days(spark, path, schema).collect()} == wanted
    assert update_days(spark, path, schema, changes.limit(0)) == 0 and files(path) == after
    text = read_days(spark, path, schema).where(in_days([("20240102", 1), ("20240104", 0)]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(" in text and "DataFilters: []" in text
