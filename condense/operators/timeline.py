"""From clips and segments of a day to an ordered timeline, an edit list and render batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from condense.functions.clock import day_offset
from condense.functions.editing import audio_choice, end_in_file, shown_length, speed, start_in_file
from condense.operators.segments import DAY, absorb_short, merge_segments
from condense.operators.series import CHUNK_ROWS, coalesce_runs, div, running, runs_to_rows, with_position
from condense.session import ship

ORDER = ["start_time", "file_start_time", "source_file", "seq_in_file"]
ORDER_SLOT = 1.0  # seconds of start time per chunk while a day is being ordered


def usable_clips(clips: DataFrame) -> DataFrame:
    """Clips that may appear in a timeline: static ones and those with segments."""
    return clips.where("prescreen_status = 'STATIC' OR analysis_segments IS NOT NULL")


def static_segments(clips: DataFrame) -> DataFrame:
    """One STATIC segment over the whole of every static clip."""
    start = day_offset(F.col("file_start_time"), F.col("date"))
    end = day_offset(F.col("file_end_time"), F.col("date"))
    return clips.where("prescreen_status = 'STATIC'").select(
        *DAY,
        "file_start_time",
        F.lit(0).cast("long").alias("seq_in_file"),
        start.alias("start_time"),
        end.alias("end_time"),
        F.lit("STATIC").alias("state"),
        F.col("path").alias("source_file"),
        start.alias("file_start_offset"),
        F.lit(0.0).alias("max_energy"),
    )


def day_segments(static: DataFrame, analysed: DataFrame) -> DataFrame:
    """All segments of the days: whole-clip segments of static clips and the segments of analysed clips."""
    cols = [*DAY, *ORDER, "end_time", "state", "file_start_offset", "max_energy"]
    return static.select(*cols).unionByName(analysed.select(*cols))


def in_order(segments: DataFrame) -> DataFrame:
    """Number the segments of a day by start time; equal starts follow clip order."""
    return with_position(segments, DAY, ORDER, F.floor(F.col("start_time") / ORDER_SLOT), "seq")


def build_timeline(
    ordered: DataFrame,
    tolerance: float = 0.5,
    min_motion: float = 2.0,
    min_static: float = 30.0,
    min_length: float = 0.1,
    absorb: bool = True,
    chunk_rows: int = CHUNK_ROWS,
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, label: df,
) -> DataFrame:
    """Merge, absorb and place the ordered segments of each day.

    Rows: day, ``seq``, ``filepath``, in-file start and end, ``state``, ``duration``.
    """
    if absorb:
        parts = absorb_short(ordered, DAY, "seq", min_motion, min_static, tolerance, chunk_rows, keep)
    else:
        parts = merge_segments(ordered, DAY, "seq", tolerance, chunk_rows)
    return in_file(parts, min_length)


def in_file(segments: DataFrame, min_length: float = 0.1) -> DataFrame:
    """Segments in seconds of their own file."""
    offset = F.col("file_start_offset")
    return (
        segments.withColumn("start_in_file", start_in_file(F.col("start_time"), offset))
        .withColumn("end_in_file", end_in_file(F.col("end_time"), offset, F.col("start_in_file"), min_length))
        .select(
            *DAY,
            "seq",
            F.col("source_file").alias("filepath"),
            "start_in_file",
            "end_in_file",
            "state",
            (F.col("end_in_file") - F.col("start_in_file")).alias("duration"),
        )
    )


def split_by_file(segments: DataFrame, clips: DataFrame, slot: float = 600.0) -> DataFrame:
    """Cut merged segments at clip borders, so that each part lies in the clip it shows.

    ``clips`` has day, ``path``, ``clip_start``, ``clip_end`` in seconds of the
    day. Both sides meet in slots of time within their day.
    """

    def slots(df, lo, hi):
        return df.withColumn("_slot", F.explode(F.sequence(F.floor(F.col(lo) / slot), F.floor(F.col(hi) / slot))))

    left = slots(segments, "start_time", "end_time")
    right = slots(clips.select(*DAY, "path", "clip_start", "clip_end"), "clip_start", "clip_end")
    lo, hi = F.greatest("start_time", "clip_start"), F.least("end_time", "clip_end")
    met = left.join(right, [*DAY, "_slot"]).where(lo < hi)
    # a pair shares several slots: keep it in the slot where the overlap begins
    once = met.where(F.floor(lo / slot) == F.col("_slot"))
    return once.select(
        *DAY,
        "seq",
        lo.alias("start_time"),
        hi.alias("end_time"),
        "state",
        F.col("path").alias("source_file"),
        F.col("clip_start").alias("file_start_offset"),
        "max_energy",
    )


def timeline_files(timeline: DataFrame, scope: list[str] = DAY) -> DataFrame:
    """The distinct files of a scope with their first position and number of segments, numbered by appearance."""
    files = timeline.groupBy(*scope, "filepath").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("segments"))
    # distinct clips only: a day of one camera has a bounded number of them
    order = W.partitionBy(*scope).orderBy("first_seq")
    return files.withColumn("input_index", (F.row_number().over(order) - 1).cast("long"))


def with_input_index(timeline: DataFrame, scope: list[str] = DAY) -> DataFrame:
    files = timeline_files(timeline, scope).select(*scope, "filepath", "input_index")
    return timeline.join(files, [*scope, "filepath"])


def edit_list(
    timeline: DataFrame,
    clips: DataFrame,
    keyframe_interval: float = 30.0,
    keyframe_display: float = 0.5,
    min_display: float = 1.5,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Source range, speed, shown length, sound and output position of every part of a day.

    ``clips`` has ``path`` and ``has_audio``; files without a row are silent.
    """
    audio = clips.select(F.col("path").alias("filepath"), "has_audio")
    shown = shown_length(F.col("state"), F.col("duration"), keyframe_interval, keyframe_display, min_display)
    rows = (
        timeline.join(audio, "filepath", "left")
        .withColumn("shown", shown)
        .withColumn("speed", speed(F.col("duration"), F.col("shown")))
        .withColumn("audio", audio_choice(F.col("state"), F.col("has_audio")))
        .drop("has_audio")
    )
    return running(rows, DAY, ["seq"], div(F.col("seq"), chunk_rows), {"output_start": ("sum", F.col("shown"))})


def batches_by_file(timeline: DataFrame, max_files: int = 4) -> DataFrame:
    """Batches for timelines whose files do not interleave: ``max_files`` files each, in order of appearance."""
    return with_input_index(timeline).withColumn("batch_idx", div(F.col("input_index"), max_files))


def batches(timeline: DataFrame, max_files: int = 4, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Cut each day into chronological batches of at most ``max_files`` distinct files; exact for interleaved files too.

    A batch ends where the next file would be one too many, which only shows when
    the sequence is read in order. Successive parts of one file are joined first,
    so what is read in order are changes of file, streamed with a set of at most
    ``max_files`` names in memory.
    """
    changes = coalesce_runs(
        timeline.withColumn("last_seq", F.col("seq")),
        DAY,
        "seq",
        {"filepath": "same", "last_seq": "last"},
        lambda prev, cur: prev("filepath") != cur("filepath"),
        chunk_rows,
    )

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        day, files, batch = None, set(), 0
        for pdf in parts:
            numbers = []
            for date, cam, path in zip(pdf["date"], pdf["cam_index"], pdf["filepath"]):
                if (date, cam) != day:
                    day, files, batch = (date, cam), set(), 0
                elif path not in files and len(files) >= max_files:
                    files, batch = set(), batch + 1
                files.add(path)
                numbers.append(batch)
            yield pdf.assign(batch_idx=pd.Series(numbers, index=pdf.index, dtype="int64"))

    ship(timeline.sparkSession)
    columns = [*DAY, "seq", "last_seq", "filepath"]
    numbered = (
        changes.select(*columns)
        .repartition(*DAY)
        .sortWithinPartitions(*DAY, "seq")
        .mapInPandas(fold, changes.select(*columns, F.lit(0).cast("long").alias("batch_idx")).schema)
    )
    return runs_to_rows(timeline, numbered, DAY, "seq", "seq", "last_seq", {"batch_idx": "batch_idx"}, chunk_rows)


def batches_by_completion(done: DataFrame, order: list[str], per_batch: int = 4) -> DataFrame:
    """Finished clips of a day in order of completion (``order``, first a whole number), ``per_batch`` to a batch."""
    return with_position(done, DAY, order, div(F.col(order[0]), CHUNK_ROWS), "_pos").withColumn("batch_idx", div(F.col("_pos"), per_batch)).drop("_pos")


def in_batch(timeline: DataFrame, batch_files: DataFrame) -> DataFrame:
    """Timeline rows whose file belongs to the batch, with file numbers of that batch."""
    keys = [*DAY, "filepath"]
    return timeline.join(batch_files.select(*keys).distinct(), keys, "left_semi")


def batch_totals(batched: DataFrame) -> DataFrame:
    """Files, parts and recorded seconds per batch; files are counted once per batch before the totals."""
    per_file = batched.groupBy(*DAY, "batch_idx", "filepath").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("duration").alias("_d")
    )
    return per_file.groupBy(*DAY, "batch_idx").agg(
        F.count(F.lit(1)).alias("files"), F.sum("_n").alias("segments"), F.sum("_d").alias("total_duration")
    )


def manifest(parts: DataFrame) -> DataFrame:
    """The part files of a day in batch order, one list per day (one entry per batch)."""
    ordered = F.array_sort(F.collect_list(F.struct("batch_idx", "part_path")))
    return parts.groupBy(*DAY).agg(F.transform(ordered, lambda p: p["part_path"]).alias("parts"))
