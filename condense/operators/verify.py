"""Checking DYNAMIC segments against detections in sampled frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from condense.operators.series import div

# Detector class numbers of person, bicycle, car, motorcycle, cat, dog.
TARGET_CLASSES = (0, 1, 2, 3, 15, 16)
FRAME_BLOCK = 4_096


def is_target(class_id: Column, conf: Column, classes=TARGET_CLASSES, confidence: float = 0.3) -> Column:
    return class_id.isin(*classes) & (conf >= F.lit(float(confidence)))


def needs_check(segment_skip_energy: float = 12.0) -> Column:
    """DYNAMIC, of some length inside its file, and not so energetic that it is taken as it is."""
    lo, hi = _local("start_time"), _local("end_time")
    return (F.col("state") == "DYNAMIC") & (hi - lo > 0) & (F.col("max_energy") < F.lit(float(segment_skip_energy)))


def _local(column: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(column) - F.col("file_start_offset"))


def sampled_hits(
    frames: DataFrame, detections: DataFrame, classes=TARGET_CLASSES, confidence: float = 0.3, block: int | None = None
) -> DataFrame:
    """One row per sampled frame: ``hit`` tells whether it shows a target.

    With ``block`` the rows lie by file and ``_block`` of so many frames, as ``segment_frames``
    joins them, so that the frames go through one shuffle from here to their segments.
    """
    keys = ["file_id", "frame_idx"]
    hits = detections.where(is_target(F.col("class_id"), F.col("conf"), classes, confidence)).select(*keys)
    hits = hits.where(F.col("file_id").isNotNull() & F.col("frame_idx").isNotNull())
    looks = frames.select(*keys, F.lit(True).alias("_seen"), F.lit(False).alias("hit"))
    looks = looks.unionByName(hits.select(*keys, F.lit(False).alias("_seen"), F.lit(True).alias("hit")))
    if block is not None:
        keys = ["file_id", "_block", "frame_idx"]
        looks = looks.withColumn("_block", div(F.col("frame_idx"), block)).repartition("file_id", "_block")
    judged = looks.groupBy(*keys).agg(F.bool_or("_seen").alias("_seen"), F.bool_or("hit").alias("hit"))
    return judged.where("_seen").drop("_seen")


def detected_hits(detected: DataFrame, classes=TARGET_CLASSES, confidence: float = 0.3) -> DataFrame:
    """The same from frames that carry their list of ``detections``: no join and no shuffle.

    A frame that could not be judged (NULL) counts as a hit, so that its segment stays as it is.
    """
    shown = F.exists("detections", lambda d: is_target(d["class_id"], d["conf"], classes, confidence))
    return detected.select("file_id", "frame_idx", F.coalesce(shown, F.lit(True)).alias("hit"))


def doubtful_frames(
    segments: DataFrame,
    frames: DataFrame,
    rate: Column,
    sample_rate: float = 0.5,
    skip_energy: float = 12.0,
    align: str = "segment",
    block: int = FRAME_BLOCK,
) -> DataFrame:
    """The frames the detector has to look at: those sampled in segments that need a check, each once.

    ``frames`` has ``file_id``, ``frame_idx`` and what the detector wants; all other
    frames are left out before any model runs.
    """
    places = frames.select("file_id", "frame_idx", F.lit(None).cast("boolean").alias("hit"))
    wanted = segment_frames(segments.where(needs_check(skip_energy)), places, rate, sample_rate, align, block)
    return frames.join(wanted.select("file_id", "frame_idx"), ["file_id", "frame_idx"], "left_semi")


def segment_frames(
    segments: DataFrame,
    frames: DataFrame,
    rate: Column,
    sample_rate: float = 0.5,
    align: str = "any",
    block: int = FRAME_BLOCK,
) -> DataFrame:
    """Pairs of a segment and the frames sampled in it, both ends included.

    ``segments`` has ``file_id`` and ``segment_id``, ``frames`` ``file_id``,
    ``frame_idx`` and ``hit``; ``rate`` is the frames per second behind
    ``frame_idx``. Frames with a ``_block`` (of ``block`` frames) already lie by it. ``align="segment"`` takes every step-th frame counted from the
    start of the segment, ``"any"`` every frame there is in the range.

    The join runs on (file, block of frames), so a long file is spread over many
    tasks and a frame only meets the segments of its own block.
    """
    if align not in ("any", "segment"):
        raise ValueError(f"unknown alignment {align}")
    start = _local("start_time")
    # the end is the start plus the length, as the check computes it
    ranged = segments.select(
        "file_id",
        "segment_id",
        F.floor(start * rate).cast("long").alias("_lo"),
        F.floor((start + (_local("end_time") - start)) * rate).cast("long").alias("_hi"),
        F.greatest(F.lit(1), F.floor(rate / F.lit(sample_rate)).cast("long")).alias("_step"),
    )
    ranged = ranged.withColumn("_block", F.explode(F.sequence(div(F.col("_lo"), block), div(F.col("_hi"), block))))
    placed = frames if "_block" in frames.columns else frames.withColumn("_block", div(F.col("frame_idx"), block))
    inside = F.col("frame_idx").between(F.col("_lo"), F.col("_hi"))
    pairs = ranged.join(placed, ["file_id", "_block"]).where(inside)
    if align == "segment":
        pairs = pairs.where((F.col("frame_idx") - F.col("_lo")) % F.col("_step") == 0)
    return pairs.select("file_id", "segment_id", "frame_idx", "hit")


def verify_segments(
    segments: DataFrame,
    frames: DataFrame,
    rate: Column,
    sample_rate: float = 0.5,
    skip_energy: float = 12.0,
    align: str = "any",
) -> DataFrame:
    """Turn DYNAMIC segments STATIC whose sampled frames show no target; no segment is dropped.

    Segments without a sampled frame stay as they are. Adds ``frames_checked``
    and ``flipped``.
    """
    doubtful = segments.where(needs_check(skip_energy))
    seen = (
        segment_frames(doubtful, frames, rate, sample_rate, align)
        .groupBy("file_id", "segment_id")
        .agg(F.count(F.lit(1)).alias("frames_checked"), F.bool_or("hit").alias("_hit"))
    )
    flipped = F.coalesce((F.col("frames_checked") > 0) & ~F.col("_hit"), F.lit(False))
    return (
        segments.join(seen, ["file_id", "segment_id"], "left")
        .withColumn("flipped", flipped)
        .withColumn("state", F.when(F.col("flipped"), "STATIC").otherwise(F.col("state")))
        .withColumn("frames_checked", F.coalesce("frames_checked", F.lit(0).cast("long")))
        .drop("_hit")
    )


def verify_report(verified: DataFrame, active: bool = True) -> DataFrame:
    """Per file: segments before and after (always equal), segments turned, and whether the check ran."""
    n = F.count(F.lit(1))
    return verified.groupBy("file_id").agg(
        n.alias("segments_before"),
        n.alias("segments_after"),
        F.count_if("flipped").alias("flipped"),
        F.lit(active).alias("verify_active"),
    )
