"""Verification over ``orders`` and ``lineitem``, and metric roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from condense.functions.clock import epoch_micros
from condense.operators import metrics as mt, registry as reg, verify as vf
from condense.plans.bound import bound, table
from condense.session import shared_dir
from condense.sources.tables import read_days, update_days, write_days, write_metrics_json, write_run_documents

DAY = ["date", "cam_index"]
RATE, OFFSET, EVERY = 2.0, 3_600.0, 3
BORDERS = (0.0, 20.0, 45.0, 60.0)


def order_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a file of 60 days that starts at OFFSET and has three segments."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    parts = [
        F.struct(F.lit(n).alias("segment_id"), F.lit(OFFSET + a).alias("start_time"), F.lit(OFFSET + b).alias("end_time"))
        for n, (a, b) in enumerate(zip(BORDERS, BORDERS[1:]))
    ]
    still = (F.col("o_orderstatus") == "F") & (F.col("segment_id") != 1)
    return (
        o.withColumn("part", F.explode(F.array(*parts)))
        .select("*", "part.*")
        .select(
            F.col("o_orderkey").alias("file_id"),
            "segment_id",
            "start_time",
            "end_time",
            F.when(still, "STATIC").otherwise("DYNAMIC").alias("state"),
            F.lit(OFFSET).alias("file_start_offset"),
            (F.col("o_totalprice") / 50_000).alias("max_energy"),
        )
    )


def order_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames the detector looked at: every third of the two frames per day, whether it saw something or not."""
    o = table(spark, sf_dir, "orders", "o_orderkey")
    frames = F.sequence(F.lit(0).cast("long"), F.lit(int(BORDERS[-1] * RATE)).cast("long"), F.lit(EVERY).cast("long"))
    return o.select(F.col("o_orderkey").alias("file_id"), F.explode(frames).alias("frame_idx"))


def line_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is a detection on the day it is shipped, counted from the date of its order."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_shipdate")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    joined = lines.join(o, lines.l_orderkey == o.o_orderkey)
    return joined.select(
        F.col("l_orderkey").alias("file_id"),
        (F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")) * int(RATE)).cast("long").alias("frame_idx"),
        F.col("l_linenumber").alias("class_id"),
        (F.col("l_discount") * 10).alias("conf"),
    ).where("frame_idx >= 0")


_DETECTIONS = """
dt AS (SELECT l_orderkey AS file_id, 2 * date_diff('day', o_orderdate, l_shipdate) AS frame_idx, l_linenumber AS class_id, l_discount * 10 AS conf
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE date_diff('day', o_orderdate, l_shipdate) >= 0),
lk AS (SELECT o_orderkey AS file_id, unnest(range(0, 121, 3)) AS frame_idx FROM orders),
ft AS (SELECT lk.file_id, lk.frame_idx, coalesce(bool_or(class_id IN (0, 1, 2, 3, 15, 16) AND conf >= 0.3::DOUBLE), false) AS hit
       FROM lk LEFT JOIN dt ON lk.file_id = dt.file_id AND lk.frame_idx = dt.frame_idx GROUP BY lk.file_id, lk.frame_idx)"""

_SEGMENTS = """
sg AS (SELECT o_orderkey AS file_id, CAST(s AS INTEGER) AS segment_id, [0, 40, 90][s + 1] AS lo, [40, 90, 120][s + 1] AS hi,
              CASE WHEN o_orderstatus = 'F' AND s <> 1 THEN 'STATIC' ELSE 'DYNAMIC' END AS state, o_totalprice / 50000 AS energy
       FROM orders, range(0, 3) r(s))"""


def _verified(aligned: bool) -> str:
    step = "AND (frame_idx - lo) % 4 = 0" if aligned else ""
    return f"""{_DETECTIONS},{_SEGMENTS},
sn AS (SELECT sg.file_id, segment_id, count(*) AS frames_checked, bool_or(hit) AS hit FROM ft JOIN sg ON ft.file_id = sg.file_id
       WHERE frame_idx BETWEEN lo AND hi {step} AND state = 'DYNAMIC' AND energy < 8 GROUP BY ALL),
vs AS (SELECT sg.file_id, sg.segment_id, coalesce(frames_checked, 0) AS frames_checked, coalesce(NOT hit, false) AS flipped,
              CASE WHEN state = 'STATIC' OR coalesce(NOT hit, false) THEN 'STATIC' ELSE 'DYNAMIC' END AS state
       FROM sg LEFT JOIN sn ON sg.file_id = sn.file_id AND sg.segment_id = sn.segment_id)"""


def seen_frames(spark: SparkSession, sf_dir: str, block: int | None = vf.FRAME_BLOCK) -> DataFrame:
    return vf.sampled_hits(order_frames(spark, sf_dir), line_detections(spark, sf_dir), block=block)


def verified(spark: SparkSession, sf_dir: str, align: str) -> DataFrame:
    return vf.verify_segments(order_segments(spark, sf_dir), seen_frames(spark, sf_dir), F.lit(RATE), 0.5, 8.0, align)


@bound("verify_segments", f"WITH {_verified(False)} SELECT * FROM vs")
def verify_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(spark, sf_dir, "any").select("file_id", "segment_id", "frames_checked", "flipped", "state")


@bound("verify_aligned", f"WITH {_verified(True)} SELECT * FROM vs")
def verify_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(spark, sf_dir, "segment").select("file_id", "segment_id", "frames_checked", "flipped", "state")


@bound("detection_hits", f"WITH {_DETECTIONS} SELECT file_id, frame_idx, hit FROM ft")
def detection_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen_frames(spark, sf_dir, None)


@bound(
    "segment_frames",
    f"""WITH {_DETECTIONS},{_SEGMENTS} SELECT ft.file_id, segment_id, frame_idx, hit FROM ft JOIN sg ON ft.file_id = sg.file_id
    WHERE frame_idx BETWEEN lo AND hi""",
)
def segment_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vf.segment_frames(order_segments(spark, sf_dir), seen_frames(spark, sf_dir), F.lit(RATE))


@bound(
    "verify_report",
    f"""WITH {_verified(False)} SELECT file_id, count(*) AS segments_before, count(*) AS segments_after,
    count(*) FILTER (flipped) AS flipped, true AS verify_active FROM vs GROUP BY file_id""",
)
def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vf.verify_report(verified(spark, sf_dir, "any"))


@bound(
    "stage_latency",
    """WITH s AS (SELECT l_returnflag AS stage, l_quantity AS d, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS r,
                         count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
    SELECT stage, count(*) AS count, round_even(sum(d), 2) AS total, round_even(avg(d), 2) AS avg,
           round_even(max(d) FILTER (r = n // 2), 2) AS p50, round_even(max(d) FILTER (r = CAST(floor(n * 0.95::DOUBLE) AS BIGINT)), 2) AS p95,
           round_even(min(d), 2) AS min, round_even(max(d), 2) AS max FROM s GROUP BY stage""",
)
def stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity").select(
        F.col("l_returnflag").alias("stage"), F.col("l_quantity").alias("duration")
    )
    return mt.stage_latency(records)


@bound(
    "metric_extra",
    """SELECT event_id, event_type AS status, json_extract_string(props, '$.k') AS k, printf('%.2f', value) AS value, 3 AS entries FROM events""",
)
def metric_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "event_type", "value", "props")
    verdict = F.create_map(F.lit("status"), F.col("event_type"), F.lit("k"), F.lit("none"))
    detail = F.from_json("props", "map<string,string>")
    stats = F.create_map(F.lit("value"), F.format_string("%.2f", "value"))
    merged = e.select("event_id", mt.merge_maps(verdict, detail, stats).alias("extra"))
    return merged.select(
        "event_id",
        F.col("extra")["status"].alias("status"),
        F.col("extra")["k"].alias("k"),
        F.col("extra")["value"].alias("value"),
        F.size("extra").alias("entries"),
    )


@bound(
    "metrics_json",
    """SELECT event_id, strftime(ts, '%Y%m%d') AS date, CAST(user_id % 4 AS INTEGER) AS cam_index, event_type AS stage, value AS duration,
    json_extract_string(props, '$.k') AS k FROM events""",
)
def metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "event_id",
        F.replace(F.col("ts").cast("date").cast("string"), F.lit("-"), F.lit("")).alias("date"),
        (F.col("user_id") % 4).cast("int").alias("cam_index"),
        F.col("event_type").alias("stage"),
        F.col("value").alias("duration"),
        F.from_json("props", "map<string,string>").alias("extra"),
    )
    path = shared_dir(spark, "metrics")
    write_metrics_json(e, path)
    back = spark.read.schema(e.schema).json(path)
    return back.select("event_id", *DAY, "stage", "duration", F.col("extra")["k"].alias("k"))


@bound(
    "first_errors",
    """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error')
    SELECT user_id, string_agg(event_id::VARCHAR, '; ' ORDER BY n) AS errors FROM r WHERE n <= 5 GROUP BY user_id""",
)
def first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events", "user_id", "ts", "event_id", "event_type").where("event_type = 'error'")
    return reg.first_errors(errors, ["user_id"], ["ts", "event_id"], "event_id")


@bound(
    "stage_resources",
    """WITH e AS (SELECT user_id AS host, event_id, event_type, epoch_us(ts) / 1e6 AS ts, value FROM events),
    st AS (SELECT host, event_type AS name, min(ts) AS start_ts, min(ts) + 43200.0::DOUBLE AS end_ts FROM e GROUP BY host, event_type),
    sa AS (SELECT host, ts, 'gpu' || (event_id % 2) AS device, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'load' ELSE 'mem' END AS metric, value FROM e),
    me AS (SELECT st.host, name, start_ts, end_ts, device, avg(value) FILTER (metric = 'load') AS avg_load, max(value) FILTER (metric = 'mem') AS peak_mem
           FROM st JOIN sa ON st.host = sa.host AND ts BETWEEN start_ts AND end_ts GROUP BY ALL)
    SELECT host, name, device, end_ts - start_ts AS duration, round(coalesce(avg_load, 0), 8) AS avg_load, coalesce(peak_mem, 0) AS peak_mem FROM me""",
)
def stage_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage of a host (user) runs 12 hours from its first event of a type; the host's events are the samples."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value").select(
        F.col("user_id").alias("host"), "event_id", "event_type", (epoch_micros(F.col("ts")) / 1e6).alias("ts"), "value"
    )
    stages = e.groupBy("host", F.col("event_type").alias("name")).agg(
        F.min("ts").alias("start_ts"), (F.min("ts") + 43_200.0).alias("end_ts")
    )
    metric = F.when(F.col("event_type").isin("click", "view", "purchase"), "load").otherwise("mem")
    samples = e.select(
        "host", "ts", F.concat(F.lit("gpu"), (F.col("event_id") % 2).cast("string")).alias("device"), metric.alias("metric"), "value"
    )
    rolled = mt.stage_resources(stages, samples, ["host"], ["load"], ["mem"])
    return rolled.withColumn("avg_load", F.round("avg_load", 8))


def _event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and camera, the events being operations of a run a day."""
    return table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value").select(
        F.replace(F.col("ts").cast("date").cast("string"), F.lit("-"), F.lit("")).alias("date"),
        (F.col("user_id") % 4).cast("int").alias("cam_index"),
        "event_id",
        F.col("event_type").alias("stage"),
        (epoch_micros(F.col("ts")) / 1e6).alias("ts"),
        F.col("value").alias("duration"),
    )


@bound(
    "run_report",
    """WITH e AS (SELECT strftime(ts, '%Y%m%d') AS date, CAST(user_id % 4 AS INTEGER) AS cam_index, event_id, event_type AS stage,
                        epoch_us(ts) / 1e6 AS ts, value FROM events),
    st AS (SELECT date, cam_index, stage, min(ts) AS start_ts, max(ts) AS end_ts FROM e GROUP BY ALL),
    sa AS (SELECT date, cam_index, ts, 'gpu' || (event_id % 2) AS device, CASE WHEN stage IN ('click', 'view', 'purchase') THEN 'load' ELSE 'mem' END AS metric, value FROM e),
    me AS (SELECT st.date, st.cam_index, st.stage, device, round_even(end_ts - start_ts, 2) AS duration,
                  round_even(round(coalesce(avg(value) FILTER (metric = 'load'), 0), 8), 1) AS avg_load, round_even(coalesce(max(value) FILTER (metric = 'mem'), 0), 1) AS peak_mem
           FROM st JOIN sa ON st.date = sa.date AND st.cam_index = sa.cam_index AND ts BETWEEN start_ts AND end_ts
           GROUP BY st.date, st.cam_index, st.stage, device, start_ts, end_ts),
    rk AS (SELECT date, cam_index, stage, value AS d, row_number() OVER (PARTITION BY date, cam_index, stage ORDER BY value) - 1 AS r,
                  count(*) OVER (PARTITION BY date, cam_index, stage) AS n FROM e),
    la AS (SELECT date, cam_index, stage, count(*) AS count, round_even(sum(d), 2) AS total, round_even(max(d) FILTER (r = n // 2), 2) AS p50,
                  round_even(max(d) FILTER (r = CAST(floor(n * 0.95::DOUBLE) AS BIGINT)), 2) AS p95 FROM rk GROUP BY ALL),
    ru AS (SELECT date, cam_index, round_even(max(ts) - min(ts), 2) AS pipeline_duration, count(*) AS n_records FROM e GROUP BY ALL)
    SELECT date, cam_index, pipeline_duration, n_records, stage, duration, device, avg_load, peak_mem, count, total, p50, p95
    FROM me JOIN la USING (date, cam_index, stage) JOIN ru USING (date, cam_index)""",
)
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of all runs, written as JSON, read back and laid out by stage and device."""
    e = _event_days(spark, sf_dir)
    stages = e.groupBy(*DAY, F.col("stage").alias("name")).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    device = F.concat(F.lit("gpu"), (F.col("event_id") % 2).cast("string")).alias("device")
    metric = F.when(F.col("stage").isin("click", "view", "purchase"), "load").otherwise("mem").alias("metric")
    samples = e.select(*DAY, "ts", device, metric, F.col("duration").alias("value"))
    records = e.select(*DAY, "stage", "duration")
    documents = mt.run_documents(records, stages, samples, DAY, ["load"], ["mem"], f"{sf_dir}/events.parquet", slot=3_600.0)
    path = shared_dir(spark, "runs")
    write_run_documents(documents, path)
    back = spark.read.schema(documents.schema).json(path)
    laid = back.select(*DAY, "pipeline_duration", F.col("records.count").alias("n_records"), "perf_summary", F.inline("monitor_summary"))
    by_device = laid.select("*", F.explode("devices").alias("device", "_figures")).withColumn("_perf", F.col("perf_summary")[F.col("name")])
    return by_device.select(
        *DAY, "pipeline_duration", "n_records", F.col("name").alias("stage"), "duration", "device", "_figures.avg_load", "_figures.peak_mem",
        "_perf.count", "_perf.total", "_perf.p50", "_perf.p95",
    )


@bound(
    "registry_update_days",
    """SELECT strftime(ts, '%Y%m%d') AS date, CAST(user_id % 4 AS INTEGER) AS cam_index, event_id,
    CASE WHEN event_type = 'error' AND day(ts) % 5 = 0 THEN 'RETRY' ELSE event_type END AS stage, value AS duration FROM events""",
)
def registry_update_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by days, in which errors of every fifth day are set to be tried again; other days are not touched."""
    rows = _event_days(spark, sf_dir).drop("ts")
    path = shared_dir(spark, "days")
    write_days(rows, path)
    errors = rows.where((F.col("stage") == "error") & (F.substring("date", 7, 2).cast("int") % 5 == 0))
    changes = errors.select(*DAY, "event_id", F.lit("RETRY").alias("stage"))
    update_days(spark, path, rows.schema, changes, ["event_id"])
    return read_days(spark, path, rows.schema)
