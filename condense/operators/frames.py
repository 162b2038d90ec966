"""Frame tables to differences, energies and prescreen verdicts.

Frames are keyed by ``file_id`` with a gapless ``i`` = 0, 1, 2, ... (the sampled
frames in order) and hold ``pixels``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from condense.functions import pixels as px
from condense.functions.sampling import luma_threshold, stream_frames, stream_point, stream_rate
from condense.operators import binary_frames as bf
from condense.operators.series import attach, chunk_window, with_halo
from condense.session import ship

FILE = ["file_id"]
TIME_BLOCK = 600.0  # seconds of a clip that meet its duration in one task
FRAME_CHUNK = 1_024  # frames are large: shorter chunks than for scalar series


def frame_changes(frames: DataFrame, chunk_rows: int = FRAME_CHUNK) -> DataFrame:
    """``luma`` of every frame and, from the second frame on, its difference to the previous and to the first frame.

    ``d`` is the larger of the two differences. The rows carry their ``_chunk``.
    ``pixels`` may be an array of numbers or BINARY, one byte per value.
    """
    if _is_binary(frames):
        names = ["luma", "diff_prev", "diff_first"]
        diffs = bf.measured(frames, names, bf.change, chunk_rows, with_first=True)
        diffs = diffs.withColumn("diff_first", F.when(F.col("i") > 0, F.col("diff_first")))
        return _with_larger(diffs.select(*FILE, "i", *names, "_chunk"))
    rows = frames.select(*FILE, "i", "pixels")
    first = rows.where("i = 0").select(*FILE, F.col("pixels").alias("_first"))
    size = rows.groupBy(*FILE).agg(F.max("i").alias("_last_i"))
    # border rows are copied first, so that the first frame joins and the
    # previous frame is found on one and the same exchange of the pixels
    haloed = with_halo(rows, FILE, "i", before=1, chunk_rows=chunk_rows)
    with_first = attach(haloed, first.join(size, FILE), FILE, "i", F.col("_last_i"), chunk_rows)
    with_prev = with_first.withColumn("_prev", F.lag("pixels").over(chunk_window(FILE, "i"))).where("_own")
    diffs = with_prev.select(
        *FILE,
        "i",
        px.luma(F.col("pixels")).alias("luma"),
        px.mean_abs_diff(F.col("pixels"), F.col("_prev")).alias("diff_prev"),
        F.when(F.col("i") > 0, px.mean_abs_diff(F.col("pixels"), F.col("_first"))).alias("diff_first"),
        "_chunk",
    )
    return _with_larger(diffs)


def _with_larger(diffs: DataFrame) -> DataFrame:
    return diffs.withColumn("d", F.when(F.col("i") > 0, F.greatest("diff_prev", "diff_first")))


def _is_binary(frames: DataFrame) -> bool:
    return isinstance(frames.schema["pixels"].dataType, T.BinaryType)


def roi_energies(
    frames: DataFrame,
    width: int,
    height: int,
    roi: tuple[float, float, float, float] = (0.1, 0.12, 0.8, 0.85),
    chunk_rows: int = FRAME_CHUNK,
) -> DataFrame:
    """Motion energy of every neighbouring pair of gray frames: ``file_id``, ``k``, ``energy``.

    Frames are cropped before they are shuffled, arrays and BINARY alike.
    """
    box = px.roi_box(width, height, roi)
    if _is_binary(frames):
        cropped = frames.select(*FILE, "i", px.crop_binary(F.col("pixels"), width, height, box).alias("pixels"))
        pairs = bf.measured(cropped, ["energy"], bf.energy_over(box[2] * box[3]), chunk_rows).where("i > 0")
        return pairs.select(*FILE, (F.col("i") - 1).alias("k"), "energy")
    cropped = frames.select(*FILE, "i", px.crop(F.col("pixels"), width, height, box).alias("_roi"))
    paired = (
        with_halo(cropped, FILE, "i", before=1, chunk_rows=chunk_rows)
        .withColumn("_prev", F.lag("_roi").over(chunk_window(FILE, "i")))
        .where("_own AND i > 0")
    )
    return paired.select(
        *FILE, (F.col("i") - 1).alias("k"), px.roi_energy(F.col("_prev"), F.col("_roi"), box).alias("energy")
    )


def with_threshold(changes: DataFrame, threshold: float) -> DataFrame:
    """Adds the threshold for the brightness of the frame and whether its change exceeds it."""
    return changes.withColumn("limit", luma_threshold(F.col("luma"), threshold)).withColumn(
        "over", F.coalesce(F.col("d") > F.col("limit"), F.lit(False))
    )


def checked_pairs(changes: DataFrame, threshold: float, chunk_rows: int = FRAME_CHUNK) -> DataFrame:
    """Rows up to the first change over its threshold: what is looked at before the early stop."""
    judged = with_threshold(changes, threshold)
    stops = judged.groupBy(*FILE).agg(
        F.max("i").alias("_last_i"), F.min(F.when(F.col("over"), F.col("i"))).alias("stop_i")
    )
    return (
        attach(judged, stops, FILE, "i", F.col("_last_i"), chunk_rows)
        .where(F.col("stop_i").isNull() | (F.col("i") <= F.col("stop_i")))
        .drop("_last_i")
    )


def _verdict(mode: str, threshold: float) -> dict[str, Column]:
    """Verdict columns over ``stopped``, ``pairs``, ``max_diff``, ``last_limit``."""
    final = F.lit(float(threshold)) if mode == "stream_fps" else F.col("last_limit")
    return {
        "threshold": F.when(F.col("stopped"), F.col("last_limit")).otherwise(final),
        "status": F.when(F.col("stopped"), "SUSPICIOUS")
        .when(F.col("pairs") == 0, "FAILED")
        .when(F.col("max_diff") > final, "SUSPICIOUS")
        .otherwise("STATIC"),
    }


def prescreen(changes: DataFrame, threshold: float = 6.0, mode: str = "stream_fps") -> DataFrame:
    """One verdict per file, with its evidence as plain columns.

    What follows the first change over its threshold is not looked at. Each chunk
    is cut at its own first such change and summed up; of the chunks of a file
    those after the first cut one are left out. One pass over the frames, no
    second exchange of rows.

    ``legacy_seek`` compares the largest change with the threshold for the last
    frame's brightness, ``stream_fps`` with the base threshold.
    """
    if mode not in ("legacy_seek", "stream_fps"):
        raise ValueError(f"unknown mode {mode}")
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    in_chunk = before(W.partitionBy(*FILE, "_chunk").orderBy("i"))
    judged = with_threshold(changes, threshold).withColumn("_done", F.max("over").over(in_chunk))
    parts = judged.where(~F.coalesce("_done", F.lit(False))).groupBy(*FILE, "_chunk").agg(
        F.max("d").alias("max_diff"),
        F.count("d").alias("pairs"),
        F.max_by("luma", "i").alias("last_luma"),
        F.max_by("limit", "i").alias("last_limit"),
        F.bool_or("over").alias("stopped"),
    )
    along = before(W.partitionBy(*FILE).orderBy("_chunk"))
    looked_at = parts.withColumn("_done", F.max("stopped").over(along)).where(~F.coalesce("_done", F.lit(False)))
    summary = looked_at.groupBy(*FILE).agg(
        F.max("max_diff").alias("max_diff"),
        F.sum("pairs").alias("pairs"),
        F.max_by("last_luma", "_chunk").alias("last_luma"),
        F.max_by("last_limit", "_chunk").alias("last_limit"),
        F.bool_or("stopped").alias("stopped"),
    )
    verdict = _verdict(mode, threshold)
    return summary.select(
        *FILE,
        verdict["status"].alias("status"),
        "max_diff",
        F.col("pairs").alias("checked_pairs"),
        verdict["threshold"].alias("threshold"),
        F.when(F.col("stopped"), F.col("last_luma")).alias("mean_luma"),
        F.col("stopped").alias("early_stop"),
    )


def sample_stream(frames: DataFrame, files: DataFrame, segments: int = 150) -> DataFrame:
    """The frames a low-rate decode yields: for its i-th point the last frame at or before that time.

    ``frames`` has ``offset_s``, ``files`` has ``duration``. The points of a clip
    are at most ``segments`` + 1, so each one is joined to its frame through the
    time slot it closes; rows of other frames are dropped before any window. Frames
    meet the duration of their clip in blocks of time, so a long clip is split.
    """
    rate = stream_rate(F.col("duration"), segments)
    slot = F.ceil(F.col("offset_s") * rate).cast("long")
    # beyond the block after the end a clip has no points
    last_block = F.floor(F.greatest("duration", F.lit(1.0)) / TIME_BLOCK) + 1
    lengths = files.select(*FILE, "duration", F.explode(F.sequence(F.lit(0).cast("long"), last_block)).alias("_block"))
    block = F.greatest(F.floor(F.col("offset_s") / TIME_BLOCK), F.lit(0).cast("long"))
    slots = (
        frames.withColumn("_block", F.when(F.col("offset_s").isNotNull(), block))
        .join(lengths, [*FILE, "_block"])
        .withColumn("_slot", slot)
        .where(F.col("_slot") < stream_frames(segments))
        .groupBy(*FILE, "_slot", "duration")
        .agg(F.max_by(F.struct("pixels", "offset_s"), "offset_s").alias("_f"))
    )
    # an empty slot shows the frame before it again, as a constant-rate decode does
    w = W.partitionBy(*FILE).orderBy("_slot")
    last_slot = F.least(F.floor(F.col("duration") * rate).cast("long"), F.lit(stream_frames(segments) - 1))
    upto = F.coalesce(F.lead("_slot").over(w) - 1, F.greatest(F.col("_slot"), last_slot))
    return (
        slots.withColumn("_upto", upto)
        .withColumn("i", F.explode(F.sequence("_slot", "_upto")))
        .select(
            *FILE, "i", stream_point(F.col("i"), F.col("duration"), segments).alias("sample_ts"), F.col("_f.pixels").alias("pixels")
        )
    )


def prescreen_detail(
    changes: DataFrame,
    samples: DataFrame,
    files: DataFrame,
    threshold: float = 6.0,
    mode: str = "stream_fps",
    segments: int = 150,
) -> DataFrame:
    """The evidence of each verdict as one JSON text per file.

    For sampled clips: a clip has at most ``segments`` + 1 samples by the
    sampling rule, so the ordered lists fit a cell. ``samples`` has
    ``sample_ts`` for each ``i``, ``files`` has ``duration``.
    """
    seen = checked_pairs(changes, threshold).join(samples.select(*FILE, "i", "sample_ts"), [*FILE, "i"])
    ordered = F.array_sort(F.collect_list(F.struct("i", "sample_ts", "d", "luma", "limit")))
    lists = seen.groupBy(*FILE).agg(
        ordered.alias("_s"), F.bool_or("over").alias("stopped"), F.count("d").alias("pairs"), F.max("d").alias("max_diff")
    )
    lists = lists.join(files.select(*FILE, "duration"), FILE).withColumn("last_limit", F.element_at("_s", -1)["limit"])
    verdict = _verdict(mode, threshold)
    rate = stream_rate(F.col("duration"), segments) if mode == "stream_fps" else F.lit(None).cast("double")
    detail = F.struct(
        F.lit(mode).alias("mode"),
        F.transform("_s", lambda s: s["sample_ts"]).alias("sample_ts"),
        F.transform(F.filter("_s", lambda s: s["d"].isNotNull()), lambda s: s["d"]).alias("diffs"),
        F.col("max_diff"),
        verdict["threshold"].alias("threshold"),
        F.when(F.col("stopped"), F.element_at("_s", -1)["luma"]).alias("mean_luma"),
        F.col("stopped").alias("early_stop"),
        F.col("pairs").alias("checked_pairs"),
        rate.alias("sample_fps"),
    )
    return lists.select(
        *FILE,
        verdict["status"].alias("prescreen_status"),
        F.to_json(detail, {"ignoreNullFields": "true"}).alias("prescreen_result"),
    )


def read_detail(clips: DataFrame, column: str = "prescreen_result") -> DataFrame:
    """Largest change and number of samples back out of the stored JSON.

    Malformed text gives NULLs, a missing field 0.
    """
    valid = F.json_object_keys(F.col(column)).isNotNull()
    samples = F.from_json(F.get_json_object(F.col(column), "$.sample_ts"), "array<double>")
    biggest = F.get_json_object(F.col(column), "$.max_diff").cast("double")
    return clips.withColumns(
        {
            "max_diff": F.when(valid, F.coalesce(biggest, F.lit(0.0))),
            "n_segments": F.when(valid, F.coalesce(F.size(samples), F.lit(0))),
        }
    )


def score_frames(frames: DataFrame, make_predict_fn, return_type, shape: list[int], batch_size: int = 64) -> DataFrame:
    """Score frames in batches with a user-given model, loaded once per Python worker.

    ``make_predict_fn`` returns a function of a NumPy batch, as
    ``pyspark.ml.functions.predict_batch_udf`` wants it; ``shape`` is that of one
    frame. Adds ``score``.
    """
    from pyspark.ml.functions import predict_batch_udf

    ship(frames.sparkSession)
    model = predict_batch_udf(
        make_predict_fn, return_type=return_type, batch_size=batch_size, input_tensor_shapes=[shape]
    )
    return frames.withColumn("score", model("pixels"))


DETECTIONS = "array<struct<class_id: int, conf: double>>"
_DETECTION = pa.list_(pa.struct([("class_id", pa.int32()), ("conf", pa.float64())]))

#: A batch of frames (a list of arrays) to a list of ``(class_id, conf)`` pairs for each of them.
Detector = Callable[[list[np.ndarray]], list[list[tuple[int, float]]]]


def detect_frames(
    frames: DataFrame,
    make_detector: Callable[[], Detector],
    shape: tuple[int, ...],
    batch_size: int = 32,
    strict: bool = True,
) -> DataFrame:
    """What a user-given detector sees in each BINARY frame: adds ``detections``, drops ``pixels``.

    ``make_detector`` loads the model once per task; it is then called with lists of
    at most ``batch_size`` frames of the given ``shape``. A frame in which nothing is
    seen has an empty list. A frame without pixels, and with ``strict=False`` each
    frame of a batch on which the detector fails, has NULL: it could not be judged.
    """
    ship(frames.sparkSession)
    if batch_size < 1:
        raise ValueError("a batch holds at least one frame")
    kept = [c for c in frames.columns if c != "pixels"]

    def seen(detector: Detector, pictures: list[np.ndarray]) -> list:
        try:
            found = detector(pictures)
            if len(found) != len(pictures):
                raise ValueError(f"{len(found)} lists of detections for {len(pictures)} frames")
            return [[{"class_id": int(c), "conf": float(p)} for c, p in frame] for frame in found]
        except Exception:
            if strict:
                raise
            return [None] * len(pictures)

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = make_detector()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                raw = part.column("pixels")
                there = [n for n in range(len(raw)) if raw[n].is_valid]
                pictures = [np.frombuffer(raw[n].as_buffer(), np.uint8).reshape(shape) for n in there]
                found = dict(zip(there, seen(detector, pictures))) if pictures else {}
                lists = pa.array([found.get(n) for n in range(len(raw))], _DETECTION)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), lists], names=[*kept, "detections"])

    fields = [frames.schema[c] for c in kept]
    return frames.select(*kept, "pixels").mapInArrow(
        detect, T.StructType([*fields, T.StructField("detections", T.DataType.fromDDL(DETECTIONS))])
    )


def detection_rows(detected: DataFrame) -> DataFrame:
    """One row per detection, ``class_id`` and ``conf``, with the other columns of its frame."""
    kept = [c for c in detected.columns if c != "detections"]
    return detected.select(*kept, F.inline("detections"))
