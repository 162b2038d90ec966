"""Segments, timelines and edit lists over ``events``.

An event is a segment of camera ``user_id % 4``; the clip it lies in is the hour
of that camera, named as clips are. A clip without an energetic event is STATIC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from condense.functions.clock import epoch_micros
from condense.operators import segments as seg, timeline as tl
from condense.operators.series import div, with_position
from condense.operators.registry import in_clip_order
from condense.plans.bound import SIZES, bound, table
from condense.session import shared_dir, written
from condense.sources.listing import list_files as list_folder
from condense.sources.tables import read_days, write_days

DAY = ["date", "cam_index"]
DAY_US = 86_400_000_000
CALM = 60.0  # a clip whose largest value stays below is STATIC


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    start = F.pmod(epoch_micros(F.col("ts")), F.lit(DAY_US)) / 1e6
    rows = rows.select(
        "event_id",
        F.replace(F.col("ts").cast("date").cast("string"), F.lit("-"), F.lit("")).alias("date"),
        (F.col("user_id") % 4).cast("int").alias("cam_index"),
        start.alias("start_time"),
        (start + F.lit(20.0) * F.col("value")).alias("end_time"),
        F.when(F.col("event_type").isin("click", "view", "purchase"), "DYNAMIC").otherwise("STATIC").alias("state"),
        F.col("value").alias("max_energy"),
        F.floor(start / 3600).cast("int").alias("_h"),
    )
    hour = F.lpad(F.col("_h").cast("string"), 2, "0")
    stamp = lambda rest: F.concat("date", hour, F.lit(rest))
    return rows.select(
        *DAY,
        "start_time",
        "end_time",
        "state",
        "max_energy",
        F.concat(F.lit("0"), F.col("cam_index").cast("string"), F.lit("_"), stamp("0000_"), stamp("5959.mp4")).alias("source_file"),
        stamp("0000").alias("file_start_time"),
        stamp("5959").alias("file_end_time"),
        (F.col("_h") * F.lit(3600.0)).alias("file_start_offset"),
        F.col("event_id").alias("seq_in_file"),
    )


def event_clips(segments: DataFrame) -> DataFrame:
    """The clips behind the segments, with verdict and sound."""
    n = F.count(F.lit(1))
    return segments.groupBy(*DAY, F.col("source_file").alias("path"), "file_start_time", "file_end_time").agg(
        F.when(F.max("max_energy") < CALM, "STATIC").otherwise("SUSPICIOUS").alias("prescreen_status"),
        F.when(n > 1, F.avg("max_energy") > 40.0).alias("has_audio"),
        F.max("seq_in_file").alias("done_at"),
    )


def merged_days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    segments = event_segments(spark, sf_dir)
    chunks = SIZES["series"]
    return seg.merge_segments(tl.in_order(segments), chunk_rows=chunks), chunks


def clip_days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """Ordered segments of all days with static clips as whole-clip segments, the clips, and the chunking."""
    segments = written(event_segments(spark, sf_dir), "segments")  # read for the clips and for the days
    clips = event_clips(segments)
    busy = clips.where("prescreen_status = 'SUSPICIOUS'").select(*DAY, F.col("path").alias("source_file"))
    analysed = segments.join(busy, [*DAY, "source_file"], "left_semi")
    days = tl.day_segments(tl.static_segments(clips), analysed)
    return tl.in_order(days), clips, SIZES["series"]


def merged_timeline(spark: SparkSession, sf_dir: str, store: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """The timeline of merged segments; ``store`` writes it first, for queries that read it more than once."""
    ordered, clips, chunks = clip_days(spark, sf_dir)
    timeline = tl.build_timeline(ordered, absorb=False, chunk_rows=chunks)
    return written(timeline, "timeline") if store else timeline, clips, chunks


_DAYS = """
d AS (SELECT event_id AS seq_in_file, strftime(ts, '%Y%m%d') AS date, CAST(user_id % 4 AS INTEGER) AS cam_index,
             hour(ts) AS h, (epoch_us(ts) % 86400000000) / 1e6 AS start_time,
             (epoch_us(ts) % 86400000000) / 1e6 + 20.0::DOUBLE * value AS end_time,
             CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'DYNAMIC' ELSE 'STATIC' END AS state,
             value AS max_energy,
             printf('%02d_', user_id % 4) || strftime(ts, '%Y%m%d%H') || '0000_' || strftime(ts, '%Y%m%d%H') || '5959.mp4' AS source_file,
             strftime(ts, '%Y%m%d%H') || '0000' AS file_start_time, hour(ts) * 3600.0::DOUBLE AS file_start_offset
      FROM events)"""
_CLIPS = f"""
clip AS (SELECT date, cam_index, h, source_file, file_start_time, file_start_offset,
                CASE WHEN max(max_energy) < {CALM} THEN 'STATIC' ELSE 'SUSPICIOUS' END AS verdict,
                CASE WHEN count(*) > 1 THEN avg(max_energy) > 40 END AS has_audio, max(seq_in_file) AS done_at
         FROM d GROUP BY ALL),
u AS (SELECT date, cam_index, start_time, end_time, state, max_energy, source_file, file_start_time, file_start_offset, seq_in_file
      FROM d WHERE source_file IN (SELECT source_file FROM clip WHERE verdict = 'SUSPICIOUS')
      UNION ALL
      SELECT date, cam_index, h * 3600.0::DOUBLE, h * 3600.0::DOUBLE + 3599.0::DOUBLE, 'STATIC', 0.0::DOUBLE, source_file, file_start_time,
             file_start_offset, 0 FROM clip WHERE verdict = 'STATIC')"""


def _merged(source: str) -> str:
    return f"""
o AS (SELECT *, row_number() OVER (PARTITION BY date, cam_index ORDER BY start_time, file_start_time, source_file, seq_in_file) - 1 AS seq
      FROM {source}),
fl AS (SELECT *, CASE WHEN lag(state) OVER w = state AND start_time - lag(end_time) OVER w <= 0.5 THEN 0 ELSE 1 END AS nw
       FROM o WINDOW w AS (PARTITION BY date, cam_index ORDER BY seq)),
gr AS (SELECT *, sum(nw) OVER (PARTITION BY date, cam_index ORDER BY seq) AS g FROM fl),
mg AS (SELECT date, cam_index, min(seq) AS seq, arg_min(start_time, seq) AS start_time, arg_max(end_time, seq) AS end_time, state,
              arg_min(source_file, seq) AS source_file, arg_min(file_start_offset, seq) AS file_start_offset, max(max_energy) AS max_energy
       FROM gr GROUP BY date, cam_index, g, state)"""


_TIMELINE = f"""{_DAYS},{_CLIPS},{_merged("u")},
pl AS (SELECT *, greatest(start_time - file_start_offset, 0.0::DOUBLE) AS start_in_file FROM mg),
p2 AS (SELECT *, greatest(end_time - file_start_offset, start_in_file + 0.1::DOUBLE) AS end_in_file FROM pl),
tm AS (SELECT date, cam_index, seq, source_file AS filepath, start_in_file, end_in_file, state,
              end_in_file - start_in_file AS duration FROM p2),
fi AS (SELECT date, cam_index, filepath, min(seq) AS first_seq, count(*) AS segments,
              row_number() OVER (PARTITION BY date, cam_index ORDER BY min(seq)) - 1 AS input_index
       FROM tm GROUP BY date, cam_index, filepath),
ba AS (SELECT tm.*, input_index, CAST(floor(input_index / 4) AS BIGINT) AS batch_idx FROM tm JOIN fi USING (date, cam_index, filepath))"""


@bound("segment_merge", f"WITH {_DAYS},{_merged('d')} SELECT * FROM mg")
def segment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_days(spark, sf_dir)[0]


@bound("segment_absorb")
def segment_absorb(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = event_segments(spark, sf_dir)
    return seg.absorb_short(tl.in_order(segments), chunk_rows=SIZES["series"], keep=written)


@bound("day_timeline", f"WITH {_TIMELINE} SELECT date, cam_index, seq, filepath, start_in_file, end_in_file, state, duration, input_index FROM ba")
def day_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    timeline, _, _ = merged_timeline(spark, sf_dir, store=True)
    return tl.with_input_index(timeline)


@bound("day_timeline_absorbed")
def day_timeline_absorbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered, _, chunks = clip_days(spark, sf_dir)
    return tl.with_input_index(tl.build_timeline(ordered, chunk_rows=chunks, keep=written))


@bound(
    "timeline_split",
    f"""WITH {_TIMELINE}
    SELECT mg.date, mg.cam_index, seq, greatest(start_time, h * 3600.0::DOUBLE) AS start_time,
           least(end_time, h * 3600.0::DOUBLE + 3599.0::DOUBLE) AS end_time, state, clip.source_file,
           clip.file_start_offset, max_energy
    FROM mg JOIN clip ON mg.date = clip.date AND mg.cam_index = clip.cam_index
     AND greatest(start_time, h * 3600.0::DOUBLE) < least(end_time, h * 3600.0::DOUBLE + 3599.0::DOUBLE)""",
)
def timeline_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered, clips, chunks = clip_days(spark, sf_dir)
    merged = seg.merge_segments(ordered, chunk_rows=chunks)
    ranges = tl.static_segments(clips.withColumn("prescreen_status", F.lit("STATIC"))).select(
        *DAY, F.col("source_file").alias("path"), F.col("start_time").alias("clip_start"), F.col("end_time").alias("clip_end")
    )
    return tl.split_by_file(merged, ranges)


@bound("timeline_files", f"WITH {_TIMELINE} SELECT date, cam_index, filepath, first_seq, segments, input_index FROM fi")
def timeline_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    timeline, _, _ = merged_timeline(spark, sf_dir)
    return tl.timeline_files(timeline)


@bound(
    "edit_list",
    f"""WITH {_TIMELINE},
    sh AS (SELECT tm.*, CASE WHEN state = 'DYNAMIC' THEN duration
                  ELSE least(greatest(duration / 60.0::DOUBLE, 1.5::DOUBLE), duration) END AS shown,
                  coalesce(has_audio, false) AS snd
           FROM tm LEFT JOIN clip ON clip.source_file = filepath)
    SELECT date, cam_index, seq, filepath, start_in_file, end_in_file, state, duration, shown,
           CASE WHEN shown > 0 THEN duration / shown ELSE 1.0 END AS speed,
           CASE WHEN state = 'DYNAMIC' AND snd THEN 'SOURCE' ELSE 'SILENT' END AS audio,
           round(coalesce(sum(shown) OVER (PARTITION BY date, cam_index ORDER BY seq
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 8) AS output_start
    FROM sh""",
)
def edit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    timeline, clips, chunks = merged_timeline(spark, sf_dir)
    return tl.edit_list(timeline, clips, chunk_rows=chunks).withColumn("output_start", F.round("output_start", 8))


@bound(
    "render_batches",
    f"""WITH {_TIMELINE} SELECT date, cam_index, batch_idx, count(DISTINCT filepath) AS files, count(*) AS segments,
    round(sum(duration), 8) AS total_duration FROM ba GROUP BY date, cam_index, batch_idx""",
)
def render_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    timeline, _, _ = merged_timeline(spark, sf_dir, store=True)
    totals = tl.batch_totals(tl.batches_by_file(timeline, 4))  # a clip is an hour: clips do not interleave
    return totals.withColumn("total_duration", F.round("total_duration", 8))


@bound(
    "batch_edit_inputs",
    f"""WITH {_TIMELINE},
    bf AS (SELECT date, cam_index, batch_idx, filepath,
                  row_number() OVER (PARTITION BY date, cam_index, batch_idx ORDER BY min(seq)) - 1 AS idx
           FROM ba GROUP BY date, cam_index, batch_idx, filepath)
    SELECT ba.date, ba.cam_index, ba.batch_idx, seq, ba.filepath, idx AS input_index
    FROM ba JOIN bf USING (date, cam_index, batch_idx, filepath)""",
)
def batch_edit_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    timeline, _, _ = merged_timeline(spark, sf_dir, store=True)
    batched = tl.batches_by_file(timeline, 4).drop("input_index")
    return tl.with_input_index(batched, [*DAY, "batch_idx"]).select(*DAY, "batch_idx", "seq", "filepath", "input_index")


@bound(
    "batch_members",
    f"WITH {_TIMELINE} SELECT date, cam_index, seq, filepath, state, duration FROM ba WHERE batch_idx = 0",
)
def batch_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    timeline, _, _ = merged_timeline(spark, sf_dir, store=True)
    files = tl.timeline_files(timeline).where(div(F.col("input_index"), 4) == 0)
    return tl.in_batch(timeline, files).select(*DAY, "seq", "filepath", "state", "duration")


@bound(
    "batch_files",
    f"WITH {_TIMELINE} SELECT date, cam_index, batch_idx, seq, filepath, state, duration FROM ba",
)
def batch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of every batch, by the fold that is exact for interleaved clips too."""
    timeline, _, chunks = merged_timeline(spark, sf_dir, store=True)
    return tl.batches(timeline, 4, chunks).select(*DAY, "batch_idx", "seq", "filepath", "state", "duration")


def part_path(batch: Column) -> Column:
    return F.format_string("_batch%d_%s_cam%d.mp4", batch, F.col("date"), F.col("cam_index"))


@bound(
    "batch_manifest",
    f"""WITH {_TIMELINE}, b AS (SELECT DISTINCT date, cam_index, batch_idx FROM ba)
    SELECT date, cam_index, string_agg(printf('_batch%d_%s_cam%d.mp4', batch_idx, date, cam_index), ',' ORDER BY batch_idx) AS parts
    FROM b GROUP BY date, cam_index""",
)
def batch_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    timeline, _, _ = merged_timeline(spark, sf_dir)
    files = tl.timeline_files(timeline).withColumn("batch_idx", div(F.col("input_index"), 4))
    parts = files.select(*DAY, "batch_idx").distinct().withColumn("part_path", part_path(F.col("batch_idx")))
    return tl.manifest(parts).withColumn("parts", F.array_join("parts", ","))


COMPLETION = f"""WITH {_DAYS},{_CLIPS}
    SELECT date, cam_index, source_file AS path, CAST(floor((row_number() OVER
        (PARTITION BY date, cam_index ORDER BY done_at, source_file) - 1) / 4) AS BIGINT) AS batch_idx FROM clip"""


@bound("completion_batches", COMPLETION)
def completion_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = event_clips(event_segments(spark, sf_dir))
    done = clips.select(*DAY, "path", "done_at")
    return tl.batches_by_completion(done, ["done_at", "path"], 4).select(*DAY, "path", "batch_idx")


@bound(
    "segment_midpoints",
    f"""WITH {_DAYS},{_merged('d')} SELECT date, cam_index, seq, state, (start_time + end_time) / 2 AS midpoint
    FROM mg WHERE end_time - start_time > 10""",
)
def segment_midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged, _ = merged_days(spark, sf_dir)
    return seg.midpoints(merged).select(*DAY, "seq", "state", "midpoint")


@bound(
    "segment_json",
    f"""WITH {_DAYS} SELECT date, cam_index, source_file, row_number() OVER (PARTITION BY date, cam_index, source_file
    ORDER BY start_time, seq_in_file) - 1 AS seq, start_time, end_time, state, max_energy, file_start_offset FROM d""",
)
def segment_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip: encode the segments of each clip, decode them again."""
    segments = event_segments(spark, sf_dir)
    keys = [*DAY, "source_file"]
    slot = F.floor(F.col("start_time") / tl.ORDER_SLOT)
    numbered = with_position(segments, keys, ["start_time", "seq_in_file"], slot, "seq")
    encoded = seg.segments_to_json(numbered.withColumn("clip", F.col("source_file")), [*DAY, "clip"], "seq")
    decoded = seg.segments_from_json(encoded)
    return decoded.select(
        *DAY,
        "source_file",
        "seq",
        "start_time",
        "end_time",
        "state",
        "max_energy",
        "file_start_offset",
    )


@bound("list_files", f"WITH {_DAYS} SELECT DISTINCT date, cam_index FROM d")
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clips written by day, then the folder listed: the days the files lie in."""
    path = shared_dir(spark, "listed")
    write_days(event_clips(event_segments(spark, sf_dir)), path)
    found = list_folder(spark, path, "*.parquet").where("length > 0")
    pattern = r"date=(\d{8})/cam_index=(\d+)/"
    day, cam = F.regexp_extract("path", pattern, 1), F.regexp_extract("path", pattern, 2).cast("int")
    return found.select(day.alias("date"), cam.alias("cam_index")).distinct()


@bound(
    "registry_scan",
    f"""WITH {_DAYS},{_CLIPS}, td AS (SELECT max(date) AS d FROM clip WHERE cam_index = 0)
    SELECT source_file AS path, date, cam_index, file_start_time, verdict AS prescreen_status FROM clip, td
    WHERE date = d AND cam_index = 0""",
)
def registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole registry written by day, the latest day of camera 0 read back in clip order."""
    clips = event_clips(event_segments(spark, sf_dir))
    path = shared_dir(spark, "registry")
    write_days(clips, path)
    latest = read_days(spark, path, clips.schema).where("cam_index = 0").agg(F.max("date")).first()[0]
    one_day = read_days(spark, path, clips.schema, latest)
    return in_clip_order(one_day).select("path", *DAY, "file_start_time", "prescreen_status")
