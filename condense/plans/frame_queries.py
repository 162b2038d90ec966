"""Frame operators over ``embeddings``: a label is a clip, its vectors in vec_id order the frames (8 x 8 pixels)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from condense.functions import pixels as px
from condense.operators import frames as fr, verify as vf
from condense.operators.series import chunk_window, div, with_halo, with_position
from condense.plans.bound import SIZES, bound, table
from condense.plans.full_run import full_run, measured_frames, screen
from condense.schemas import PRESCREEN_DETAIL
from condense.session import ship, written

FILE = ["file_id"]
WIDTH = HEIGHT = 8
ROI = (0.1, 0.12, 0.8, 0.85)
LIMIT = 16.0
FRAME_SECONDS = 0.5
SEGMENTS = 20


def embedding_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Frames with gapless ``i`` and whole pixel values around 50, so that bright and dark pictures occur."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("file_id"),
        "vec_id",
        F.transform(
            "embedding", lambda x: F.greatest(F.floor((x.cast("double") + 0.5) * 100), F.lit(0)).cast("int")
        ).alias("pixels"),
    )
    chunks = SIZES["frames"]
    return with_position(rows, FILE, ["vec_id"], div(F.col("vec_id"), chunks), "i"), chunks


_FRAMES = """
fr AS (SELECT label::BIGINT AS file_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, vec_id,
              list_transform(embedding, lambda x: greatest(CAST(floor((x::DOUBLE + 0.5) * 100) AS INTEGER), 0)) AS px FROM embeddings)"""
_DIFF = "list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2]))) / 64.0::DOUBLE"


def _changes(source: str) -> str:
    return f"""
pv AS (SELECT *, lag(px) OVER (PARTITION BY file_id ORDER BY i) AS pp, first_value(px) OVER (PARTITION BY file_id ORDER BY i) AS p0 FROM {source}),
df AS (SELECT file_id, i, list_sum(px) / 64.0::DOUBLE AS luma,
              CASE WHEN i > 0 THEN {_DIFF.format(a="px", b="pp")} END AS diff_prev,
              CASE WHEN i > 0 THEN {_DIFF.format(a="px", b="p0")} END AS diff_first FROM pv),
ch AS (SELECT *, CASE WHEN i > 0 THEN greatest(diff_prev, diff_first) END AS d,
              CASE WHEN luma < 50 THEN greatest(1.5::DOUBLE, {LIMIT} * 0.3::DOUBLE) ELSE {LIMIT}::DOUBLE END AS lim FROM df)"""


def _verdicts(final: str) -> str:
    return f"""
st AS (SELECT file_id, min(i) FILTER (d > lim) AS stop_i FROM ch GROUP BY file_id),
se AS (SELECT ch.*, stop_i FROM ch JOIN st USING (file_id) WHERE stop_i IS NULL OR i <= stop_i),
su AS (SELECT file_id, max(d) AS max_diff, count(d) AS checked_pairs, arg_max(luma, i) AS last_luma, arg_max(lim, i) AS last_limit,
              bool_or(stop_i IS NOT NULL) AS stopped FROM se GROUP BY file_id),
ve AS (SELECT file_id, CASE WHEN stopped THEN 'SUSPICIOUS' WHEN checked_pairs = 0 THEN 'FAILED'
              WHEN max_diff > {final} THEN 'SUSPICIOUS' ELSE 'STATIC' END AS status, max_diff, checked_pairs,
              CASE WHEN stopped THEN last_limit ELSE {final} END AS threshold, CASE WHEN stopped THEN last_luma END AS mean_luma,
              stopped AS early_stop FROM su)"""


@bound("frame_luma", f"WITH {_FRAMES} SELECT file_id, i, list_sum(px) / 64.0::DOUBLE AS luma FROM fr")
def frame_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, _ = embedding_frames(spark, sf_dir)
    return frames.select(*FILE, "i", px.luma(F.col("pixels")).alias("luma"))


@bound("frame_diff", f"WITH {_FRAMES},{_changes('fr')} SELECT file_id, i, luma, diff_prev, diff_first, d FROM ch")
def frame_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, chunks = embedding_frames(spark, sf_dir)
    return fr.frame_changes(frames, chunks).drop("_chunk")


# the 8 x 8 picture cropped to columns 0..5 and rows 0..5
_ROI = "list_concat(px[1:6], px[9:14], px[17:22], px[25:30], px[33:38], px[41:46])"
_ENERGY = f"""
rc AS (SELECT file_id, i, {_ROI} AS r FROM fr),
rp AS (SELECT *, lag(r) OVER (PARTITION BY file_id ORDER BY i) AS q FROM rc),
en AS (SELECT file_id, i - 1 AS k, list_sum(list_transform(list_zip(r, q), lambda z: abs(z[1] - z[2]))) / 36.0::DOUBLE AS energy
       FROM rp WHERE i > 0)"""


@bound("frame_energy", f"WITH {_FRAMES},{_ENERGY} SELECT file_id, k, energy FROM en")
def frame_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, chunks = embedding_frames(spark, sf_dir)
    return fr.roi_energies(frames, WIDTH, HEIGHT, ROI, chunks)


def _binary(frames: DataFrame) -> DataFrame:
    """The same frames as BINARY, one byte per pixel, by built-in functions."""
    digits = F.transform("pixels", lambda x: F.lpad(F.hex(F.least(x, F.lit(255)).cast("long")), 2, "0"))
    return frames.withColumn("pixels", F.unhex(F.array_join(digits, "")))


@bound("frame_kernels", f"WITH {_FRAMES},{_changes('fr')},{_ENERGY} SELECT ch.file_id, i, luma, diff_prev, energy FROM ch LEFT JOIN en ON ch.file_id = en.file_id AND i - 1 = k")
def frame_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brightness, difference and ROI energy of BINARY frames by the Arrow kernels."""
    ship(spark)
    frames, chunks = embedding_frames(spark, sf_dir)
    box = px.roi_box(WIDTH, HEIGHT, ROI)
    paired = (
        with_halo(_binary(frames), FILE, "i", before=1, chunk_rows=chunks)
        .withColumn("_prev", F.lag("pixels").over(chunk_window(FILE, "i")))
        .where("_own")
    )
    return paired.select(
        *FILE,
        "i",
        px.luma_binary("pixels").alias("luma"),
        px.mean_abs_diff_binary("pixels", "_prev").alias("diff_prev"),
        px.roi_energy_binary(WIDTH, HEIGHT, box)("_prev", "pixels").alias("energy"),
    )


@bound("prescreen_seek", f"WITH {_FRAMES},{_changes('fr')},{_verdicts('last_limit')} SELECT * FROM ve")
def prescreen_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, chunks = embedding_frames(spark, sf_dir)
    return fr.prescreen(fr.frame_changes(frames, chunks), LIMIT, "legacy_seek")


PRESCREEN_STREAM = f"WITH {_FRAMES},{_changes('fr')},{_verdicts(f'{LIMIT}::DOUBLE')} SELECT * FROM ve"


@bound("prescreen_stream", PRESCREEN_STREAM)
def prescreen_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, chunks = embedding_frames(spark, sf_dir)
    return fr.prescreen(fr.frame_changes(frames, chunks), LIMIT, "stream_fps")


_SAMPLED = f"""
cd AS (SELECT file_id, count(*) * {FRAME_SECONDS}::DOUBLE AS dur FROM fr GROUP BY file_id),
sl AS (SELECT file_id, dur, unnest(range({SEGMENTS} + 1)) AS i FROM cd),
sq AS (SELECT file_id, i, least(i / ({SEGMENTS}.0::DOUBLE / greatest(dur, 1.0::DOUBLE)), dur) AS sample_ts,
              ({SEGMENTS}.0::DOUBLE / greatest(dur, 1.0::DOUBLE)) AS rate, dur FROM sl),
sm AS (SELECT sq.file_id, sq.i, sample_ts, arg_max(fr.px, fr.i) AS px FROM sq JOIN fr ON fr.file_id = sq.file_id
       AND ceil(fr.i * {FRAME_SECONDS}::DOUBLE * rate) <= sq.i WHERE sq.i <= floor(dur * rate) GROUP BY ALL)"""


def sampled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    frames, _ = embedding_frames(spark, sf_dir)
    files = frames.groupBy(*FILE).agg((F.count(F.lit(1)) * FRAME_SECONDS).alias("duration"))
    timed = frames.withColumn("offset_s", F.col("i") * FRAME_SECONDS)
    return fr.sample_stream(timed, files, SEGMENTS), files


@bound(
    "prescreen_detail",
    f"""WITH {_FRAMES},{_SAMPLED},{_changes("sm")},{_verdicts(f"{LIMIT}::DOUBLE")}
    SELECT file_id, status AS prescreen_status, round(ve.max_diff, 9) AS max_diff, checked_pairs, early_stop, threshold,
           checked_pairs + 1 AS n_segments,
           string_agg(CAST(round(d * 1000) AS BIGINT)::VARCHAR, ',' ORDER BY i) FILTER (i > 0) AS diffs_milli
    FROM ve JOIN se USING (file_id) GROUP BY ALL""",
)
def prescreen_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a low-rate decode, judged, written as JSON and read back."""
    samples, files = sampled(spark, sf_dir)
    changes = fr.frame_changes(samples)
    stored = fr.prescreen_detail(changes, samples, files, LIMIT, "stream_fps", SEGMENTS)
    back = fr.read_detail(stored).withColumn("_d", F.from_json("prescreen_result", PRESCREEN_DETAIL))
    return back.select(
        *FILE,
        "prescreen_status",
        F.round("max_diff", 9).alias("max_diff"),
        "_d.checked_pairs",
        "_d.early_stop",
        "_d.threshold",
        F.col("n_segments").cast("long").alias("n_segments"),
        F.array_join(F.transform("_d.diffs", lambda d: F.round(d * 1000).cast("long").cast("string")), ",").alias("diffs_milli"),
    )


def weighted_sum_model():
    """Stand-in model: a fixed weighting of the pixels, for batches of frames."""
    import numpy as np

    def predict(batch: np.ndarray) -> np.ndarray:
        values = np.asarray(batch, dtype=np.float64)
        return values @ np.arange(1, values.shape[1] + 1, dtype=np.float64)

    return predict


@bound(
    "score_frames",
    f"""WITH {_FRAMES} SELECT file_id, i, list_sum(list_transform(range(1, 65), lambda j: px[j] * j))::DOUBLE AS score,
    list_sum(list_transform(range(1, 65), lambda j: px[j] * j)) > 104000 AS hit FROM fr""",
)
def score_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, _ = embedding_frames(spark, sf_dir)
    floats = frames.select(*FILE, "i", F.col("pixels").cast(T.ArrayType(T.DoubleType())).alias("pixels"))
    scored = fr.score_frames(floats, weighted_sum_model, T.DoubleType(), [WIDTH * HEIGHT])
    return scored.select(*FILE, "i", "score", (F.col("score") > 104_000).alias("hit"))


def byte_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    frames, chunks = embedding_frames(spark, sf_dir)
    return _binary(frames), chunks


@bound("frame_diff_binary", f"WITH {_FRAMES},{_changes('fr')} SELECT file_id, i, luma, diff_prev, diff_first, d FROM ch")
def frame_diff_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, chunks = byte_frames(spark, sf_dir)
    return fr.frame_changes(frames, chunks).drop("_chunk")


@bound("frame_energy_binary", f"WITH {_FRAMES},{_ENERGY} SELECT file_id, k, energy FROM en")
def frame_energy_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, chunks = byte_frames(spark, sf_dir)
    return fr.roi_energies(frames, WIDTH, HEIGHT, ROI, chunks)


@bound("prescreen_seek_binary", f"WITH {_FRAMES},{_changes('fr')},{_verdicts('last_limit')} SELECT * FROM ve")
def prescreen_seek_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, chunks = byte_frames(spark, sf_dir)
    return fr.prescreen(fr.frame_changes(frames, chunks), LIMIT, "legacy_seek")


@bound("prescreen_stream_binary", PRESCREEN_STREAM)
def prescreen_stream_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, chunks = byte_frames(spark, sf_dir)
    return fr.prescreen(fr.frame_changes(frames, chunks), LIMIT, "stream_fps")


def corner_detector():
    """Stand-in detector: two objects a frame, classes and confidences from its sum and corner pixels."""

    def detect(pictures):
        return [
            [(int(p.sum()) % 20, int(p[0, 0]) % 101 / 100), (int(p[1, 1]) % 20, int(p[0, 1]) % 101 / 100)]
            for p in pictures
        ]

    return detect


CHECK_FRAMES, SKIP_ENERGY = 16, 18.0

_DETECTED = """
sn AS (SELECT fr.file_id, i // 16 AS segment_id, min(i) AS lo, max(i) AS hi, max(energy) AS energy,
              CASE WHEN i // 16 % 3 = 2 THEN 'STATIC' ELSE 'DYNAMIC' END AS state
       FROM fr LEFT JOIN en ON fr.file_id = en.file_id AND fr.i = en.k + 1 GROUP BY fr.file_id, i // 16),
ob AS (SELECT file_id, i, unnest([list_sum(px) % 20, px[10] % 20]) AS class_id, unnest([px[1] % 101 / 100, px[2] % 101 / 100]) AS conf FROM fr),
lk AS (SELECT sn.file_id, segment_id, ob.i, bool_or(class_id IN (0, 1, 2, 3, 15, 16) AND conf >= 0.3::DOUBLE) AS hit
       FROM sn JOIN ob ON ob.file_id = sn.file_id AND ob.i BETWEEN lo AND hi AND (ob.i - lo) % 2 = 0
       WHERE state = 'DYNAMIC' AND hi > lo AND energy < 18 GROUP BY ALL)"""


def _checked_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Segments of 16 frames (one a second) with their largest energy, and the frames the detector looked at."""
    frames, chunks = byte_frames(spark, sf_dir)
    energies = fr.roi_energies(frames, WIDTH, HEIGHT, ROI, chunks)
    seconds = frames.select(*FILE, "i").join(energies.withColumn("i", F.col("k") + 1), [*FILE, "i"], "left")
    number = div(F.col("i"), CHECK_FRAMES)
    segments = (
        seconds.groupBy(*FILE, number.alias("segment_id"))
        .agg(F.min("i").cast("double").alias("start_time"), F.max("i").cast("double").alias("end_time"), F.max("energy").alias("max_energy"))
        .withColumn("state", F.when(F.col("segment_id") % 3 == 2, "STATIC").otherwise("DYNAMIC"))
        .withColumn("file_start_offset", F.lit(0.0))
    )
    pictures = frames.select(*FILE, F.col("i").alias("frame_idx"), "pixels")
    doubtful = vf.doubtful_frames(segments, pictures, F.lit(1.0), skip_energy=SKIP_ENERGY)
    return segments, fr.detect_frames(doubtful, corner_detector, (HEIGHT, WIDTH))


@bound(
    "frame_detections",
    f"""WITH {_FRAMES},{_ENERGY},{_DETECTED} SELECT DISTINCT ob.file_id, ob.i AS frame_idx, ob.class_id, ob.conf
    FROM ob JOIN lk ON lk.file_id = ob.file_id AND lk.i = ob.i""",
)
def frame_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels to detections of the frames in doubt."""
    return fr.detection_rows(_checked_frames(spark, sf_dir)[1]).withColumn("class_id", F.col("class_id").cast("long")).distinct()


@bound(
    "score_to_verdict",
    f"""WITH {_FRAMES},{_ENERGY},{_DETECTED},
    ch AS (SELECT file_id, segment_id, count(*) AS frames_checked, bool_or(hit) AS hit FROM lk GROUP BY ALL)
    SELECT sn.file_id, sn.segment_id, coalesce(frames_checked, 0) AS frames_checked, coalesce(NOT hit, false) AS flipped,
           CASE WHEN coalesce(NOT hit, false) THEN 'STATIC' ELSE state END AS state
    FROM sn LEFT JOIN ch ON sn.file_id = ch.file_id AND sn.segment_id = ch.segment_id""",
)
def score_to_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels to energies, segments, detections in the frames in doubt and the verdict on each segment."""
    segments, detected = _checked_frames(spark, sf_dir)
    checked = vf.verify_segments(segments, vf.detected_hits(detected), F.lit(1.0), skip_energy=SKIP_ENERGY, align="segment")
    return checked.select(*FILE, "segment_id", "frames_checked", "flipped", "state")


def embedding_clips(frames: DataFrame) -> DataFrame:
    """A clip per label, ten minutes apart on one day, each as long as its frames last."""
    stamp = lambda s: F.concat(F.lit("20240101"), F.date_format(F.timestamp_seconds(s), "HHmmss"))
    sized = frames.groupBy("file_id").agg((F.count(F.lit(1)) * FRAME_SECONDS).alias("file_duration"))
    start = F.col("file_id") * 600
    return sized.select(
        F.col("file_id").cast("string").alias("path"),
        F.lit("20240101").alias("date"),
        (F.col("file_id") % 2).cast("int").alias("cam_index"),
        stamp(start).alias("file_start_time"),
        stamp(start + F.ceil("file_duration")).alias("file_end_time"),
        "file_duration",
        (F.col("file_id") % 3 == 0).alias("has_audio"),
    )


NATIVE_FPS = 10.0


def _clips_and_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """Frames with their time in the clip, and the clips; both keyed by text."""
    frames, chunks = embedding_frames(spark, sf_dir)
    timed = frames.select(F.col("file_id").cast("string").alias("file_id"), "i", (F.col("i") * FRAME_SECONDS).alias("offset_s"), "pixels")
    return timed, embedding_clips(timed), chunks


@bound(
    "sampled_verdicts",
    f"""WITH {_FRAMES},{_SAMPLED},{_changes("sm")},{_verdicts(f"{LIMIT}::DOUBLE")}
    SELECT file_id::VARCHAR AS file_id, status, max_diff, checked_pairs, threshold, mean_luma, early_stop FROM ve""",
)
def sampled_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The screening of the full run: 21 points of a clip."""
    frames, clips, chunks = _clips_and_frames(spark, sf_dir)
    return screen(frames, clips, LIMIT, segments=SEGMENTS, frame_chunk=chunks)


@bound(
    "strided_energies",
    f"""WITH {_FRAMES},
    sd AS (SELECT file_id, greatest(1, CAST(round_even({NATIVE_FPS} / CASE WHEN count(*) * {FRAME_SECONDS} <= 120 THEN 5
                  WHEN count(*) * {FRAME_SECONDS} <= 600 THEN 2 ELSE 1 END, 0) AS BIGINT)) AS stride FROM fr GROUP BY file_id),
    sf AS (SELECT fr.file_id, i // stride AS i, px FROM fr JOIN sd ON fr.file_id = sd.file_id WHERE i % stride = 0),
    {_ENERGY.replace("FROM fr)", "FROM sf)")}
    SELECT file_id::VARCHAR AS file_id, k, energy FROM en""",
)
def strided_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The energies of the full run: frames at the rate for the length of their clip."""
    frames, clips, chunks = _clips_and_frames(spark, sf_dir)
    return fr.roi_energies(measured_frames(frames, clips, NATIVE_FPS, chunks), WIDTH, HEIGHT, ROI, chunks)


@bound("full_run")
def full_run_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames to edit list: sampled screening, motion analysis at the clip's rate, segments, timeline, cut."""
    frames, clips, chunks = _clips_and_frames(spark, sf_dir)
    tables = full_run(
        frames,
        clips,
        WIDTH,
        HEIGHT,
        threshold=LIMIT,
        chunk_rows=chunks,
        frame_chunk=chunks,
        screen_segments=SEGMENTS,
        native_fps=NATIVE_FPS,
        keep=written,
        early_window=5,
        early_threshold=12.0,
    )
    return tables.edits
