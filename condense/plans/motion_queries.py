"""Motion operators over ``events``: a user is a file, its events in (ts, event_id) order the energies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from condense.functions.clock import epoch_micros
from condense.operators import motion, segments as seg
from condense.operators.series import attach, div, with_position
from condense.plans.bound import SIZES, bound, table
from condense.session import shared_dir, written
from condense.sources.tables import LABEL_CSV, write_label_csv

FILE = ["file_id"]
HOUR = 3_600_000_000  # microseconds per chunk while events are being numbered
NATIVE_FPS, SECONDS_PER_FRAME = 30.0, 10.0


def event_energies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The energy series and how its files are to be chunked."""
    rows = table(spark, sf_dir, "events", "user_id", "ts", "event_id", "value").select(
        F.col("user_id").alias("file_id"), epoch_micros(F.col("ts")).alias("us"), "event_id", F.col("value").alias("energy")
    )
    return with_position(rows, FILE, ["us", "event_id"], div(F.col("us"), HOUR)), SIZES["series"]


def labels_of(energies: DataFrame, chunks: int) -> DataFrame:
    thresholds = motion.noise_threshold(energies, sensitivity=1.0)
    return motion.raw_labels(energies, thresholds, chunks, carry=("us",)).withColumnRenamed("us", "time")


_SERIES = """
e AS (SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k,
             value AS energy, epoch_us(ts) AS us, event_id FROM events)"""


def _thresholds(source: str) -> str:
    return f"""
th AS (SELECT file_id, count(*) AS n, quantile_cont(energy, 0.05) AS p5, quantile_cont(energy, 0.2) AS p20,
              quantile_cont(energy, 0.05) + greatest(0.5, (quantile_cont(energy, 0.2) - quantile_cont(energy, 0.05)) * 2.5) AS threshold
       FROM {source} GROUP BY file_id)"""


def _labels(source: str, us: str) -> str:
    return f"""
s0 AS (SELECT file_id, k + 1 AS i, energy > threshold AS m, energy, {us} AS us FROM {source} JOIN th USING (file_id) WHERE n >= 2
       UNION ALL
       SELECT file_id, 0, false, 0.0, {us} FROM {source} JOIN th USING (file_id) WHERE n >= 2 AND k = 0)"""


def _medians(source: str) -> str:
    return f"""
x AS (SELECT file_id, k, list(energy) OVER w AS xs, count(*) OVER (PARTITION BY file_id) AS n FROM {source}
      WINDOW w AS (PARTITION BY file_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
md AS (SELECT file_id, k, list_sort(list_concat(
           list_transform(range(greatest(3 - k, 0)), lambda j: xs[1]), xs,
           list_transform(range(greatest(k + 3 - (n - 1), 0)), lambda j: xs[len(xs)])))[4] AS energy FROM x)"""


_THRESHOLDS = _thresholds("e")
_LABELS = _labels("e", "us")


def _islands(source: str, out: str) -> str:
    """SQL of the runs of equal ``m``: adds run number g and run length c."""
    return f"""
{out}a AS (SELECT *, lag(m) OVER (PARTITION BY file_id ORDER BY i) AS pm FROM {source}),
{out}b AS (SELECT *, sum(CASE WHEN m IS DISTINCT FROM pm THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY i) AS g FROM {out}a),
{out} AS (SELECT *, count(*) OVER (PARTITION BY file_id, g) AS c FROM {out}b)"""


_SMOOTH = ",".join([
    _islands("s0", "r0"),
    """
s1 AS (SELECT file_id, i, energy, us,
              CASE WHEN m AND c < 3 THEN false WHEN NOT m AND c < 2 THEN true ELSE m END AS m FROM r0)""",
    _islands("s1", "r1"),
    """
s2 AS (SELECT file_id, i, energy, us, CASE WHEN NOT m AND c < 5 THEN true ELSE m END AS m FROM r1)""",
])
_CHAIN = "WITH " + ",".join([_SERIES, _THRESHOLDS, _LABELS, _SMOOTH])


@bound("motion_threshold", f"""WITH {_SERIES},{_THRESHOLDS}
    SELECT file_id, n, round(p5, 9) AS p5, round(p20, 9) AS p20, round(threshold, 9) AS threshold FROM th""")
def motion_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    energies, _ = event_energies(spark, sf_dir)
    return motion.noise_threshold(energies).select(
        "file_id", "n", *[F.round(c, 9).alias(c) for c in ("p5", "p20", "threshold")]
    )


@bound("motion_smooth", f"{_CHAIN} SELECT file_id, i, energy, m AS is_motion FROM s2")
def motion_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    energies, chunks = event_energies(spark, sf_dir)
    return motion.smooth_labels(labels_of(energies, chunks), chunk_rows=chunks).select("file_id", "i", "energy", "is_motion")


@bound(
    "motion_ratio",
    f"""{_CHAIN} SELECT file_id, count(*) AS labels, count(*) FILTER (m) AS motion_labels,
    count(*) FILTER (NOT m) AS static_labels, count(*) FILTER (m) / count(*) AS motion_ratio FROM s2 GROUP BY file_id""",
)
def motion_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    energies, chunks = event_energies(spark, sf_dir)
    return motion.motion_ratio(motion.label_runs(labels_of(energies, chunks), chunk_rows=chunks))


@bound(
    "motion_segments",
    f"""{_CHAIN},{_islands("s2", "r2")},
    z AS (SELECT file_id, us AS us0 FROM e WHERE k = 0)
    SELECT file_id, min(i) AS first_i, (arg_min(us, i) - any_value(us0)) / 1e6 AS start_time,
           (arg_max(us, i) - any_value(us0)) / 1e6 AS end_time,
           CASE WHEN m THEN 'DYNAMIC' ELSE 'STATIC' END AS state, max(energy) AS max_energy
    FROM r2 JOIN z USING (file_id) GROUP BY file_id, g, m""",
)
def motion_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    energies, chunks = event_energies(spark, sf_dir)
    runs = motion.label_runs(labels_of(energies, chunks), chunk_rows=chunks)
    starts = (
        table(spark, sf_dir, "events", "user_id", "ts")
        .groupBy(F.col("user_id").alias("file_id"))
        .agg(epoch_micros(F.min("ts")).alias("us0"))
    )
    since = lambda c: ((F.col(c) - F.col("us0")) / 1e6).alias(c)
    timed = runs.join(starts, FILE).select(*FILE, "first_i", since("start_time"), since("end_time"), "is_motion", "max_energy")
    return seg.runs_to_segments(timed).select(
        *FILE, F.col("seq").alias("first_i"), "start_time", "end_time", "state", "max_energy"
    )


@bound(
    "median_energy",
    f"WITH {_SERIES},{_medians('e')} SELECT file_id, k, energy FROM md",
)
def median_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    energies, chunks = event_energies(spark, sf_dir)
    return motion.running_median(energies.select(*FILE, "k", "energy"), 7, chunks)


_EARLY = """
w5 AS (SELECT *, max(energy) OVER (PARTITION BY file_id ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS peak FROM e),
ends AS (SELECT file_id, max(k) AS last_k, min(k) FILTER (k >= 4 AND peak < 20) AS stop_k FROM w5 GROUP BY file_id),
kept AS (SELECT e.file_id, k, energy, stop_k IS NOT NULL AS early FROM e JOIN ends USING (file_id) WHERE stop_k IS NULL OR k <= stop_k
         UNION ALL SELECT file_id, stop_k + 1, 0.0, true FROM ends WHERE stop_k IS NOT NULL)"""


@bound("early_terminate", f"WITH {_SERIES},{_EARLY} SELECT file_id, k, energy, early FROM kept")
def early_terminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    energies, chunks = event_energies(spark, sf_dir)
    return motion.cut_quiet_tail(energies, 5, 20.0, chunks)


@bound(
    "early_known",
    f"""WITH {_SERIES},{_EARLY} SELECT file_id, k, energy, early FROM kept JOIN ends USING (file_id)
    WHERE file_id % 3 = 0 OR stop_k IS NULL OR k <= stop_k""",
)
def early_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closing zero only where the duration is known: two files in three have none or 0."""
    energies, chunks = event_energies(spark, sf_dir)
    known = F.when(F.col("file_id") % 3 == 0, 100.0).when(F.col("file_id") % 3 == 1, 0.0)
    files = table(spark, sf_dir, "events", "user_id").select(F.col("user_id").alias("file_id")).distinct()
    return motion.cut_quiet_tail(energies, 5, 20.0, chunks, files.withColumn("duration", known))


@bound(
    "label_axis_true",
    f"""WITH {_SERIES},{_EARLY},
    p AS (SELECT file_id, max(k) + 1 AS last_i, bool_or(early) AS early FROM kept GROUP BY file_id),
    f AS (SELECT file_id, count(*) * 10.0::DOUBLE AS duration FROM e GROUP BY file_id),
    l AS (SELECT file_id, k + 1 AS i FROM kept UNION ALL SELECT file_id, 0 FROM kept WHERE k = 0)
    SELECT file_id, i, round(CASE WHEN early AND i = last_i THEN duration ELSE
           least(i * (1.0::DOUBLE / CASE WHEN duration <= 120 THEN 5.0::DOUBLE WHEN duration <= 600 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END), duration) END, 6) AS time
    FROM l JOIN p USING (file_id) JOIN f USING (file_id)""",
)
def label_axis_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times by the sampling rate instead of spread over the clip."""
    return _label_times(spark, sf_dir, "true")


@bound(
    "sample_stride",
    f"""WITH {_SERIES},
    f AS (SELECT file_id, count(*) * 10.0 AS duration FROM e GROUP BY file_id),
    s AS (SELECT file_id, CAST(round_even(30.0 / CASE WHEN duration <= 120 THEN 5 WHEN duration <= 600 THEN 2 ELSE 1 END, 0) AS BIGINT) AS stride FROM f)
    SELECT file_id, k, stride, energy FROM e JOIN s USING (file_id) WHERE k % stride = 0""",
)
def sample_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    energies, _ = event_energies(spark, sf_dir)
    files = table(spark, sf_dir, "events", "user_id").groupBy(F.col("user_id").alias("file_id")).agg(
        (F.count(F.lit(1)) * SECONDS_PER_FRAME).alias("duration")
    )
    stride = motion.frame_stride(F.lit(NATIVE_FPS), motion.sampling_rate(F.col("duration")))
    strides = files.select(*FILE, stride.cast("long").alias("stride"))
    return motion.every_kth(energies.join(strides, FILE), "k", F.col("stride")).select(*FILE, "k", "stride", "energy")


@bound(
    "transitions",
    f"""WITH {_SERIES},{_THRESHOLDS},{_LABELS},
    t AS (SELECT *, lag(m) OVER (PARTITION BY file_id ORDER BY i) AS pm FROM s0),
    x AS (SELECT file_id, i, us AS time, CASE WHEN m THEN 'MOTION_START' ELSE 'MOTION_END' END AS direction,
                 row_number() OVER (PARTITION BY file_id ORDER BY i) AS rn FROM t WHERE m <> pm)
    SELECT file_id, i, time, direction FROM x WHERE rn <= 40""",
)
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    energies, chunks = event_energies(spark, sf_dir)
    raw_runs = motion.label_runs(labels_of(energies, chunks), chunk_rows=chunks, smooth=False)
    return seg.transitions(raw_runs, first=40)


@bound(
    "all_transitions",
    f"""WITH {_SERIES},{_THRESHOLDS},{_LABELS},
    t AS (SELECT *, lag(m) OVER (PARTITION BY file_id ORDER BY i) AS pm FROM s0)
    SELECT file_id, i, us AS time, CASE WHEN m THEN 'MOTION_START' ELSE 'MOTION_END' END AS direction FROM t WHERE m <> pm""",
)
def all_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    energies, chunks = event_energies(spark, sf_dir)
    return seg.transitions(motion.label_runs(labels_of(energies, chunks), chunk_rows=chunks, smooth=False))


@bound(
    "label_axis",
    f"""WITH {_SERIES},{_EARLY},
    p AS (SELECT file_id, max(k) + 1 AS last_i, bool_or(early) AS early,
                 max(k) + CASE WHEN bool_or(early) THEN 1 ELSE 2 END AS frames FROM kept GROUP BY file_id),
    f AS (SELECT file_id, count(*) * 10.0::DOUBLE AS duration FROM e GROUP BY file_id),
    l AS (SELECT file_id, k + 1 AS i FROM kept UNION ALL SELECT file_id, 0 FROM kept WHERE k = 0)
    SELECT file_id, i, round(CASE WHEN early AND i = last_i THEN duration
           ELSE least(i * (1.0::DOUBLE / (frames / duration)), duration) END, 6) AS time
    FROM l JOIN p USING (file_id) JOIN f USING (file_id)""",
)
def label_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _label_times(spark, sf_dir, "compat")


def _label_times(spark: SparkSession, sf_dir: str, axis: str) -> DataFrame:
    energies, chunks = event_energies(spark, sf_dir)
    cut = motion.cut_quiet_tail(energies, 5, 20.0, chunks)
    files = energies.groupBy(*FILE).agg((F.count(F.lit(1)) * SECONDS_PER_FRAME).alias("duration"))
    ended = cut.groupBy(*FILE).agg(F.max("early").alias("early"), F.max("k").alias("last_k")).join(files, FILE)
    axes = ended.select(
        *FILE,
        "duration",
        "early",
        (F.col("last_k") + 1).alias("last_i"),
        (F.col("last_k") + F.when(F.col("early"), 1).otherwise(2)).alias("frames"),
    )
    steps = F.explode(F.when(F.col("k") == 0, F.array(F.lit(0).cast("long"), F.col("k") + 1)).otherwise(F.array(F.col("k") + 1)))
    labels = cut.select(*FILE, steps.alias("i"))
    time = motion.label_time(
        F.col("i"), F.col("last_i"), F.col("duration"), F.col("frames"), motion.sampling_rate(F.col("duration")), F.col("early"), axis=axis
    )
    return attach(labels, axes, FILE, "i", F.col("last_i"), chunks).select(*FILE, "i", F.round(time, 6).alias("time"))


@bound(
    "label_csv",
    f"""{_CHAIN} SELECT file_id, i AS frame_index, printf('%.2f', (us % 100000000000) / 1e6) AS time_sec, 1 AS is_motion,
    printf('%d:%05.2f', CAST(floor((us % 100000000000) / 1e6 / 60) AS BIGINT), fmod((us % 100000000000) / 1e6, 60.0)) AS formatted_time
    FROM s2 WHERE m""",
)
def label_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    energies, chunks = event_energies(spark, sf_dir)
    smooth = motion.smooth_labels(labels_of(energies, chunks), chunk_rows=chunks)
    path = shared_dir(spark, "label-csv")
    write_label_csv(smooth.withColumn("time", (F.col("time") % 100_000_000_000) / 1e6), path)
    return spark.read.schema(LABEL_CSV).option("header", True).csv(path)


@bound(
    "analyze_files",
    f"""WITH {_SERIES},{_EARLY},{_medians("kept")},{_thresholds("md")},{_labels("md", "0")},{_SMOOTH},{_islands("s2", "r2")},
    p AS (SELECT file_id, max(k) + 1 AS last_i, bool_or(early) AS early,
                 max(k) + CASE WHEN bool_or(early) THEN 1 ELSE 2 END AS frames FROM kept GROUP BY file_id),
    f AS (SELECT file_id, count(*) * 10.0::DOUBLE AS duration FROM e GROUP BY file_id),
    t AS (SELECT r2.*, CASE WHEN early AND i = last_i THEN duration
                 ELSE least(i * (1.0::DOUBLE / (frames / duration)), duration) END AS time
          FROM r2 JOIN p USING (file_id) JOIN f USING (file_id))
    SELECT file_id, min(i) AS first_i, max(i) AS last_i, count(*) AS labels, m AS is_motion,
           round(arg_min(time, i), 6) AS start_time, round(arg_max(time, i), 6) AS end_time, max(energy) AS max_energy
    FROM t GROUP BY file_id, g, m""",
)
def analyze_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    energies, chunks = event_energies(spark, sf_dir)
    files = energies.groupBy(*FILE).agg(
        (F.count(F.lit(1)) * SECONDS_PER_FRAME).alias("duration"), F.lit(0.0).alias("offset")
    )
    runs = motion.analyze(energies, early_window=5, early_threshold=20.0, files=files, chunk_rows=chunks, keep=written)
    return runs.withColumns({c: F.round(c, 6) for c in ("start_time", "end_time")})
