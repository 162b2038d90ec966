"""From frames and clips to the edit lists of all days, as one job over all of them.

Each stage is a table the next one reads only for the clips that need it: the
cheap screening decides which clips are analysed, the energies decide which
segments are checked against detections. ``keep`` stores such a table; on a
cluster pass ``condense.session.written`` or a writer of your own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from condense.functions.clock import day_offset
from condense.functions.sampling import known_duration
from condense.operators import frames as fr, motion, segments as seg, timeline as tl, verify as vf
from condense.operators.series import CHUNK_ROWS, attach

DAY = ["date", "cam_index"]
Keep = Callable[[DataFrame, str], DataFrame]


@dataclass
class Tables:
    """The tables of a run; ``registry`` has the state of every clip after it."""

    verdicts: DataFrame
    registry: DataFrame
    timeline: DataFrame
    edits: DataFrame
    segments: DataFrame


def measured_frames(
    frames: DataFrame, clips: DataFrame, native_fps: float | None = None, frame_chunk: int = fr.FRAME_CHUNK
) -> DataFrame:
    """The frames of the given clips that are measured, numbered ``i`` = 0, 1, 2, ... again.

    With ``native_fps``, the frames per second of the recording, every so many of
    them as the rate for the length of the clip asks for, joined in chunks of a clip;
    all of them otherwise.
    """
    if native_fps is None:
        return frames.join(clips.select(F.col("path").alias("file_id")), "file_id", "left_semi")
    rate = motion.sampling_rate(known_duration(F.col("file_duration")))
    stride = motion.frame_stride(F.lit(float(native_fps)), rate).cast("long")
    sizes = frames.groupBy("file_id").agg(F.max("i").alias("_last_i"))
    strides = clips.select(F.col("path").alias("file_id"), stride.alias("_stride")).join(sizes, "file_id")
    kept = attach(frames.select("file_id", "i", "pixels"), strides, ["file_id"], "i", F.col("_last_i"), frame_chunk)
    kept = motion.every_kth(kept, "i", F.col("_stride"))
    return kept.select("file_id", F.floor(F.col("i") / F.col("_stride")).cast("long").alias("i"), "pixels")


def screen(
    frames: DataFrame,
    clips: DataFrame,
    threshold: float = 6.0,
    mode: str = "stream_fps",
    segments: int | None = None,
    frame_chunk: int = fr.FRAME_CHUNK,
) -> DataFrame:
    """One verdict per clip with frames; with ``segments`` from at most that many + 1 samples over its length.

    Samples need ``offset_s``, the time of each frame in its clip.
    """
    if segments is None:
        return fr.prescreen(fr.frame_changes(frames, frame_chunk), threshold, mode)
    files = clips.select(F.col("path").alias("file_id"), known_duration(F.col("file_duration")).alias("duration"))
    return fr.prescreen(fr.frame_changes(fr.sample_stream(frames, files, segments), frame_chunk), threshold, mode)


def analyse_clips(
    frames: DataFrame,
    clips: DataFrame,
    width: int,
    height: int,
    detections: DataFrame | None = None,
    sampled: DataFrame | None = None,
    roi: tuple[float, float, float, float] = (0.1, 0.12, 0.8, 0.85),
    skip_energy: float = 12.0,
    chunk_rows: int = CHUNK_ROWS,
    frame_chunk: int = fr.FRAME_CHUNK,
    native_fps: float | None = None,
    keep: Keep = lambda df, label: df,
    **options,
) -> DataFrame:
    """Segments of the given clips; DYNAMIC ones are checked if there are ``detections``.

    ``frames`` has ``file_id``, ``i`` and gray ``pixels``, ``clips`` ``path``, the day,
    stamps and ``file_duration``. ``sampled`` (``file_id``, ``frame_idx``) lists all
    frames the detector looked at, also those in which it saw nothing; by default it
    looked at every measured frame of a segment that is a multiple of the step from
    its start. ``frame_idx`` counts the measured frames (see ``measured_frames``).
    """
    files = clips.select(
        F.col("path").alias("file_id"),
        known_duration(F.col("file_duration")).alias("duration"),
        day_offset(F.col("file_start_time"), F.col("date"), clamp=True).alias("offset"),
    )
    measured = measured_frames(frames, clips, native_fps, frame_chunk)
    energies = keep(fr.roi_energies(measured, width, height, roi, frame_chunk), "energies")
    runs = motion.analyze(energies, files=files, chunk_rows=chunk_rows, keep=keep, **options)
    rows = runs.join(files, "file_id")
    parts = seg.runs_to_segments(rows, offset=F.col("offset"))
    if detections is None:
        return parts
    looked = measured.select("file_id", F.col("i").alias("frame_idx")) if sampled is None else sampled
    hits = vf.sampled_hits(looked, detections)
    rated = parts.withColumn("segment_id", F.col("seq")).join(
        files.select("file_id", motion.sampling_rate(F.col("duration")).alias("_rate")), "file_id"
    )
    align = "segment" if sampled is None else "any"
    checked = vf.verify_segments(rated, hits, F.col("_rate"), skip_energy=skip_energy, align=align)
    return checked.select(*parts.columns)


def full_run(
    frames: DataFrame,
    clips: DataFrame,
    width: int,
    height: int,
    detections: DataFrame | None = None,
    threshold: float = 6.0,
    mode: str = "stream_fps",
    chunk_rows: int = CHUNK_ROWS,
    frame_chunk: int = fr.FRAME_CHUNK,
    screen_segments: int | None = None,
    native_fps: float | None = None,
    keep: Keep = lambda df, label: df,
    **options,
) -> Tables:
    """Screen, analyse, check, lay out and cut all days of ``clips``.

    ``frames`` hold what was decoded. By default that is what is to be looked at: every
    frame is screened and measured. With ``screen_segments`` (and ``offset_s`` in
    ``frames``) a clip is screened at that many + 1 points of its length, with
    ``native_fps`` measured at the rate for its length.
    """
    verdicts = keep(screen(frames, clips, threshold, mode, screen_segments, frame_chunk), "verdicts")
    judged = clips.join(
        verdicts.select(F.col("file_id").alias("path"), F.col("status").alias("prescreen_status")), "path", "left"
    ).withColumn("prescreen_status", F.coalesce("prescreen_status", F.lit("FAILED")))  # no frame could be read
    busy = judged.where("prescreen_status = 'SUSPICIOUS'")
    segments = keep(
        analyse_clips(
            frames, busy, width, height, detections, chunk_rows=chunk_rows, frame_chunk=frame_chunk,
            native_fps=native_fps, keep=keep, **options,
        ),
        "segments",
    )
    placed = segments.join(busy.select(F.col("path").alias("file_id"), *DAY, "file_start_time"), "file_id")
    analysed = placed.withColumn("seq_in_file", F.col("seq"))
    days = tl.day_segments(tl.static_segments(judged), analysed)
    timeline = keep(tl.build_timeline(tl.in_order(days), chunk_rows=chunk_rows, keep=keep), "timeline")
    return Tables(verdicts, clip_states(judged, segments), timeline, tl.edit_list(timeline, clips, chunk_rows=chunk_rows), segments)


def clip_states(judged: DataFrame, segments: DataFrame) -> DataFrame:
    """Registry rows after a run: ``analysis_status`` and the stored segments of every clip.

    A clip to analyse that has no segments (fewer than two energies) has FAILED;
    one that needed no analysis stays PENDING.
    """
    stored = seg.segments_to_json(segments, ["file_id"]).withColumnRenamed("file_id", "path")
    busy, found = F.col("prescreen_status") == "SUSPICIOUS", F.col("analysis_segments").isNotNull()
    return judged.drop("analysis_status", "analysis_segments").join(stored, "path", "left").withColumn(
        "analysis_status", F.when(busy & found, "ANALYZED").when(busy, "FAILED").otherwise("PENDING")
    )


def inspect(
    energies: DataFrame,
    files: DataFrame,
    detections: DataFrame | None = None,
    sampled: DataFrame | None = None,
    min_motion: float = 2.0,
    min_static: float = 30.0,
    chunk_rows: int = CHUNK_ROWS,
    keep: Keep = lambda df, label: df,
    **options,
) -> dict[str, DataFrame]:
    """What one looks at to judge the detection: statistics, segments before and after the check, changes of label.

    ``detections`` come with ``sampled``, all frames the detector looked at: one in
    which it saw nothing has no detection, but it is what the check is for.
    """
    if detections is not None and sampled is None:
        raise ValueError("detections need the sampled frames they were made from")
    runs = keep(motion.analyze(energies, files=files, chunk_rows=chunk_rows, keep=keep, **options), "runs")
    raw = seg.runs_to_segments(runs)
    absorb = lambda df: seg.absorb_short(df, ["file_id"], "seq", min_motion, min_static, chunk_rows=chunk_rows, keep=keep)
    found = {"statistics": motion.motion_ratio(runs), "segments": absorb(raw), "transitions": seg.transitions(runs)}
    if detections is not None:
        rated = raw.withColumn("segment_id", F.col("seq")).join(
            files.select("file_id", motion.sampling_rate(F.col("duration")).alias("_rate")), "file_id"
        )
        checked = vf.verify_segments(rated, vf.sampled_hits(sampled, detections), F.col("_rate"))
        found["verified"] = absorb(checked.select(*raw.columns))
    found["midpoints"] = seg.midpoints(found.get("verified", found["segments"]))
    return found
