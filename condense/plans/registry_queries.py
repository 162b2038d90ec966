"""Clip intake and registry operators over ``orders``: an order is a clip with a made-up name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from condense.functions import names, sampling
from condense.operators import registry as reg, timeline as tl
from condense.plans.bound import bound, table
from condense.session import written
from condense.sources import listing as ls

DAY = ["date", "cam_index"]
AS_OF = "2001-08-02 00:00:00"


def _clock(seconds: Column) -> Column:
    parts = [F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60]
    return F.concat(*[F.lpad(p.cast("string"), 2, "0") for p in parts])


def order_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing whose names, sizes and change times come from the orders.

    Low priorities get an upper-case ending, unspecified ones the month 13. The
    listing is written first: the operators then read plain columns instead of
    making up every name again.
    """
    o = table(spark, sf_dir, "orders")
    start = F.col("o_orderkey") % 80_000
    month = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "13").otherwise(F.substring("_day", 5, 2))
    date = F.concat(F.substring("_day", 1, 4), month, F.substring("_day", 7, 2))
    ending = F.when(F.col("o_orderpriority") == "5-LOW", ".MP4").otherwise(".mp4")
    o = o.withColumn("_day", F.replace(F.col("o_orderdate").cast("date").cast("string"), F.lit("-"), F.lit("")))
    path = F.concat(
        F.lit("/clips/"),
        F.col("o_orderkey").cast("string"),
        F.lit("/0"),
        (F.col("o_custkey") % 4).cast("string"),
        F.lit("_"),
        date,
        _clock(start),
        F.lit("_"),
        date,
        _clock(start + 60 + F.col("o_custkey") % 600),
        ending,
    )
    listing = o.select(
        path.alias("path"),
        F.expr(f"timestamp_ntz'{AS_OF}' - make_dt_interval(0, 0, cast(o_orderkey % 30 as int), 0)").alias("modificationTime"),
        F.floor(F.col("o_totalprice") * 100).cast("long").alias("length"),
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
    )
    return written(listing, "listing")


def order_second_look(found: DataFrame) -> DataFrame:
    """A later listing: clips of some customers have grown, those of others are gone."""
    grown = F.when(F.col("o_custkey") % 7 == 0, F.col("length") + 1).otherwise(F.col("length"))
    return found.where(F.col("o_custkey") % 11 != 0).select("path", grown.alias("length"))


def order_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry: verdicts follow the order status, the analysis the priority."""
    clips = ls.clip_names(order_listing(spark, sf_dir))
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return clips.select(
        "path",
        *DAY,
        "file_start_time",
        "file_end_time",
        "file_duration",
        F.when(status == "F", "STATIC").when(status == "O", "SUSPICIOUS").otherwise("PENDING").alias("prescreen_status"),
        F.when(priority == "1-URGENT", "ANALYZED").when(priority == "2-HIGH", "FAILED").otherwise("PENDING").alias("analysis_status"),
        "o_orderkey",
    )


_ORDERS = f"""
ol AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice,
              CAST(floor(o_totalprice * 100) AS BIGINT) AS length, o_orderkey % 30 AS age, o_orderkey % 80000 AS s,
              o_orderkey % 80000 + 60 + o_custkey % 600 AS t,
              strftime(o_orderdate, '%Y') || CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '13' ELSE strftime(o_orderdate, '%m') END
                  || strftime(o_orderdate, '%d') AS date FROM orders),
l AS (SELECT *, '/clips/' || o_orderkey || printf('/%02d_', o_custkey % 4)
             || date || printf('%02d%02d%02d', s // 3600, s % 3600 // 60, s % 60) || '_'
             || date || printf('%02d%02d%02d', t // 3600, t % 3600 // 60, t % 60)
             || CASE WHEN o_orderpriority = '5-LOW' THEN '.MP4' ELSE '.mp4' END AS path FROM ol),
n AS (SELECT path, CAST(o_custkey % 4 AS INTEGER) AS cam_index, date,
             date || printf('%02d%02d%02d', s // 3600, s % 3600 // 60, s % 60) AS file_start_time,
             date || printf('%02d%02d%02d', t // 3600, t % 3600 // 60, t % 60) AS file_end_time,
             CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN (t - s)::DOUBLE END AS file_duration,
             length, age, o_custkey, o_orderkey, o_orderstatus, o_orderpriority
      FROM l WHERE o_orderpriority <> '5-LOW'),
cl AS (SELECT path, date, cam_index, file_start_time, file_end_time, file_duration, o_orderkey,
              CASE o_orderstatus WHEN 'F' THEN 'STATIC' WHEN 'O' THEN 'SUSPICIOUS' ELSE 'PENDING' END AS prescreen_status,
              CASE o_orderpriority WHEN '1-URGENT' THEN 'ANALYZED' WHEN '2-HIGH' THEN 'FAILED' ELSE 'PENDING' END AS analysis_status
       FROM n)"""
_INTAKE = """
ck AS (SELECT *, CASE WHEN file_duration IS NULL THEN 'quarantined'
                      WHEN age < 10 OR (age < 15 AND (o_custkey % 11 = 0 OR o_custkey % 7 = 0)) THEN 'frozen'
                      ELSE 'added' END AS intake,
              (length * 8) / (file_duration * 1000) AS kbps FROM n)"""


@bound(
    "clip_names",
    f"""WITH {_ORDERS} SELECT path, cam_index, date, file_start_time, file_end_time, file_duration,
    (length * 8) / (file_duration * 1000) AS kbps FROM n""",
)
def clip_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = ls.clip_names(order_listing(spark, sf_dir))
    return clips.select(
        "path", *DAY, "file_start_time", "file_end_time", "file_duration", ls.kbps(F.col("length"), F.col("file_duration")).alias("kbps")
    )


def classified(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    found = order_listing(spark, sf_dir)
    as_of = F.expr(f"timestamp_ntz'{AS_OF}'")
    return ls.classify(ls.clip_names(found), as_of, order_second_look(found), min_kbps=500.0, **options)


@bound(
    "clip_classify",
    f"""WITH {_ORDERS},{_INTAKE} SELECT path, intake,
    CASE WHEN intake = 'added' THEN CASE WHEN kbps < 500 THEN 'STATIC' ELSE 'PENDING' END END AS prescreen_status,
    CASE WHEN intake = 'added' AND kbps < 500 THEN 'low_bitrate' END AS reason FROM ck""",
)
def clip_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select(
        "path", "intake", "prescreen_status", F.get_json_object("prescreen_result", "$.reason").alias("reason")
    )


@bound(
    "clip_classify_skip_today",
    f"""WITH {_ORDERS}, td AS (SELECT max(date) AS today FROM n WHERE file_duration IS NOT NULL)
    SELECT path, CASE WHEN file_duration IS NULL THEN 'quarantined' WHEN date = today THEN 'skipped' ELSE 'added' END AS intake
    FROM n, td""",
)
def clip_classify_skip_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Today is the latest day there is; the age of files does not matter then."""
    clips = ls.clip_names(order_listing(spark, sf_dir))
    latest = clips.where("file_duration IS NOT NULL").agg(F.max("date")).first()[0]
    as_of = F.to_timestamp_ntz(F.lit(latest), F.lit("yyyyMMdd"))
    return ls.classify(clips, as_of, skip_today=True).select("path", "intake")


@bound(
    "intake_counts",
    f"""WITH {_ORDERS},{_INTAKE} SELECT count(*) FILTER (intake = 'added' AND o_orderstatus <> 'F') AS added,
    count(*) FILTER (intake = 'added' AND o_orderstatus = 'F') AS known, count(*) FILTER (intake = 'skipped') AS skipped,
    count(*) FILTER (intake = 'frozen') AS frozen, count(*) FILTER (intake = 'quarantined') AS quarantined FROM ck""",
)
def intake_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = order_clips(spark, sf_dir).where("prescreen_status = 'STATIC'")
    return ls.intake_counts(classified(spark, sf_dir), known)


@bound("registry_insert", f"WITH {_ORDERS} SELECT path, prescreen_status FROM cl")
def registry_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static clips are registered; then all clips are found, some of them twice."""
    clips = order_clips(spark, sf_dir)
    old = clips.where("prescreen_status = 'STATIC'")
    found = clips.union(clips.where("analysis_status = 'PENDING'"))
    return reg.insert_new(old, found).select("path", "prescreen_status")


@bound(
    "registry_update",
    f"""WITH {_ORDERS}, ch AS (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem GROUP BY l_orderkey)
    SELECT path, CASE WHEN q IS NULL THEN prescreen_status WHEN q > 40 THEN 'SUSPICIOUS' ELSE 'STATIC' END AS prescreen_status,
           analysis_status FROM cl LEFT JOIN ch ON o_orderkey = l_orderkey""",
)
def registry_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = order_clips(spark, sf_dir).withColumnRenamed("o_orderkey", "clip_id")
    loudest = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").groupBy(F.col("l_orderkey").alias("clip_id")).agg(
        F.max("l_quantity").alias("_q")
    )
    changes = loudest.select("clip_id", F.when(F.col("_q") > 40, "SUSPICIOUS").otherwise("STATIC").alias("prescreen_status"))
    return reg.update(clips, changes, ["clip_id"]).select("path", "prescreen_status", "analysis_status")


_DAY_STATES = """
dy AS (SELECT date, cam_index, count(*) AS n, max(file_duration) AS longest FROM cl GROUP BY date, cam_index),
du AS (SELECT date, cam_index, CASE WHEN longest > 400 THEN 'COMPLETED' WHEN longest > 200 THEN 'FAILED'
              WHEN n > 1 THEN 'RENDERING' ELSE 'PENDING' END AS status FROM dy)"""


def day_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of several clips start as RENDERING, the others as PENDING; days with long clips are then set anew."""
    days = order_clips(spark, sf_dir).groupBy(*DAY).agg(F.count(F.lit(1)).alias("n"), F.max("file_duration").alias("longest"))
    first = days.select(*DAY, F.when(F.col("n") > 1, "RENDERING").otherwise("PENDING").alias("status"), F.lit(1).alias("updated_at"))
    done = days.where("longest > 200").select(
        *DAY, F.when(F.col("longest") > 400, "COMPLETED").otherwise("FAILED").alias("status"), F.lit(2).alias("updated_at")
    )
    return reg.upsert(first, done)


@bound("day_upsert", f"WITH {_ORDERS},{_DAY_STATES} SELECT date, cam_index, status FROM du")
def day_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_status(spark, sf_dir).select(*DAY, "status")


@bound(
    "day_outcome",
    f"""WITH {_ORDERS},{_DAY_STATES} SELECT count(*) AS total, count(*) FILTER (status = 'COMPLETED') AS ok,
    count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status NOT IN ('COMPLETED', 'FAILED')) AS not_run FROM du""",
)
def day_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.run_outcome(day_status(spark, sf_dir))


_PENDING = """count(*) FILTER (prescreen_status = 'PENDING')"""
_WAITING = """count(*) FILTER (prescreen_status = 'SUSPICIOUS' AND analysis_status = 'PENDING')"""


@bound(
    "day_actions",
    f"""WITH {_ORDERS},{_DAY_STATES}, pc AS (SELECT date, cam_index, {_PENDING} + {_WAITING} AS pending FROM cl GROUP BY date, cam_index)
    SELECT date, cam_index, pending, CASE WHEN status = 'COMPLETED' AND pending = 0 THEN 'skip'
           WHEN status = 'COMPLETED' THEN 'reopen' ELSE 'run' END AS action FROM pc JOIN du USING (date, cam_index)""",
)
def day_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = reg.pending_counts(order_clips(spark, sf_dir))
    return reg.day_actions(counts, day_status(spark, sf_dir)).select(*DAY, "pending", "action")


@bound(
    "pending_counts",
    f"""WITH {_ORDERS} SELECT date, cam_index, count(*) AS clips, {_PENDING} AS prescreen_pending, {_WAITING} AS analysis_pending,
    {_PENDING} + {_WAITING} AS pending, {_PENDING} = 0 AS prescreen_complete, {_WAITING} = 0 AS analysis_complete
    FROM cl GROUP BY date, cam_index""",
)
def pending_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.pending_counts(order_clips(spark, sf_dir))


@bound(
    "verdict_counts",
    f"""WITH {_ORDERS} SELECT date, cam_index, count(*) FILTER (prescreen_status <> 'PENDING') AS done,
    count(*) FILTER (prescreen_status = 'STATIC') AS static, count(*) FILTER (prescreen_status = 'SUSPICIOUS') AS suspicious,
    count(*) FILTER (prescreen_status = 'FAILED') AS failed FROM cl GROUP BY date, cam_index""",
)
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.verdict_counts(order_clips(spark, sf_dir))


@bound("day_list", f"WITH {_ORDERS} SELECT DISTINCT date, cam_index FROM cl ORDER BY date, cam_index")
def day_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.day_list(order_clips(spark, sf_dir))


@bound(
    "pending_clips",
    f"""WITH {_ORDERS} SELECT path, file_start_time, 'prescreen' AS stage FROM cl WHERE prescreen_status = 'PENDING'
    UNION ALL SELECT path, file_start_time, 'analysis' FROM cl WHERE prescreen_status = 'SUSPICIOUS' AND analysis_status = 'PENDING'""",
)
def pending_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = order_clips(spark, sf_dir)
    waiting = reg.prescreen_pending(clips).withColumn("stage", F.lit("prescreen"))
    waiting = waiting.unionByName(reg.analysis_pending(clips).withColumn("stage", F.lit("analysis")))
    return reg.in_clip_order(waiting).select("path", "file_start_time", "stage")


@bound(
    "clip_routes",
    f"""WITH {_ORDERS} SELECT path, CASE WHEN prescreen_status = 'PENDING' THEN 'prescreen' WHEN prescreen_status = 'STATIC' THEN 'timeline'
    WHEN analysis_status = 'PENDING' THEN 'analysis' WHEN analysis_status = 'ANALYZED' THEN 'timeline' ELSE 'failed' END AS route FROM cl""",
)
def clip_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.route(order_clips(spark, sf_dir)).select("path", "route")


@bound(
    "usable_clips",
    f"""WITH {_ORDERS}, ls AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 25)
    SELECT path, prescreen_status FROM cl LEFT JOIN ls ON o_orderkey = l_orderkey
    WHERE prescreen_status = 'STATIC' OR l_orderkey IS NOT NULL""",
)
def usable_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips with a verdict or with stored segments; a large line item stands for the latter."""
    stored = (
        table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity")
        .where("l_quantity > 25")
        .select(F.col("l_orderkey").alias("o_orderkey"), F.lit("[]").alias("analysis_segments"))
        .distinct()
    )
    return tl.usable_clips(order_clips(spark, sf_dir).join(stored, "o_orderkey", "left")).select("path", "prescreen_status")


@bound(
    "output_names",
    f"WITH {_ORDERS} SELECT DISTINCT date, cam_index, 'DailyVlog_' || date || '_cam' || cam_index || '.mp4' AS output_file FROM cl",
)
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = order_clips(spark, sf_dir).select(*DAY).distinct()
    return days.withColumn("output_file", names.output_name(F.col("date"), F.col("cam_index")))


@bound(
    "sample_points",
    f"""WITH {_ORDERS}, du AS (SELECT path, coalesce(nullif(file_duration, 0), 300.0::DOUBLE) AS d FROM n),
    pt AS (SELECT path, d, unnest(range(6)) AS i FROM du)
    SELECT path, i, greatest(least(i * (d / 5), d - 0.5::DOUBLE), 0.0::DOUBLE) AS seek_ts,
           least(i / greatest(1.0::DOUBLE / greatest(d, 1.0::DOUBLE), 5.0::DOUBLE / greatest(d, 1.0::DOUBLE)), d) AS stream_ts FROM pt""",
)
def sample_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = ls.clip_names(order_listing(spark, sf_dir))
    rows = clips.select("path", sampling.known_duration(F.col("file_duration")).alias("d"))
    points = rows.select("path", "d", F.posexplode(sampling.seek_points(F.col("d"), 5)).alias("i", "seek_ts"))
    return points.select(
        "path", F.col("i").cast("long").alias("i"), "seek_ts", sampling.stream_point(F.col("i"), F.col("d"), 5).alias("stream_ts")
    )
