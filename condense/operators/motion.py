"""Energy series to motion labels: early end, median, noise floor, smoothing, time axis.

Series are keyed by ``file_id`` with a gapless ``k`` = 0, 1, 2, ...; labels
count ``i`` = 0, 1, 2, ... with one label more than there are energies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from condense.operators.ranks import percentiles
from condense.operators.series import (
    CHUNK_ROWS,
    attach,
    chunk_window,
    coalesce_runs,
    div,
    runs_to_rows,
    with_halo,
)

FILE = ["file_id"]


def early_end(
    energies: DataFrame, window: int = 20, threshold: float = 2.5, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Per file: ``last_k`` and ``stop_k``, the first k whose last ``window`` energies all stay below ``threshold``."""
    haloed = with_halo(energies.select(*FILE, "k", "energy"), FILE, "k", before=window - 1, chunk_rows=chunk_rows)
    frame = chunk_window(FILE, "k").rowsBetween(-(window - 1), 0)
    tested = haloed.withColumn("_peak", F.max("energy").over(frame)).where("_own")
    hit = (F.col("k") >= window - 1) & (F.col("_peak") < threshold)
    return tested.groupBy(*FILE).agg(F.max("k").alias("last_k"), F.min(F.when(hit, F.col("k"))).alias("stop_k"))


def cut_quiet_tail(
    energies: DataFrame,
    window: int = 20,
    threshold: float = 2.5,
    chunk_rows: int = CHUNK_ROWS,
    files: DataFrame | None = None,
) -> DataFrame:
    """Drop energies after the early end and append one 0.0 to each ended file.

    With ``files`` (``file_id``, ``duration``) only where the duration is known: the
    zero stands for the end of the file, which has no place on the time axis
    otherwise. Adds ``early`` (bool): whether the file of the row was ended early.
    """
    ends = early_end(energies, window, threshold, chunk_rows)
    kept = (
        attach(energies.select(*FILE, "k", "energy"), ends, FILE, "k", F.col("last_k"), chunk_rows)
        .where(F.col("stop_k").isNull() | (F.col("k") <= F.col("stop_k")))
        .select(*FILE, "k", "energy", F.col("stop_k").isNotNull().alias("early"))
    )
    ended = ends.where("stop_k IS NOT NULL")
    if files is not None:
        ended = ended.join(files.where(has_duration(F.col("duration"))).select(*FILE), FILE, "left_semi")
    closing = ended.select(
        *FILE, (F.col("stop_k") + 1).alias("k"), F.lit(0.0).alias("energy"), F.lit(True).alias("early")
    )
    return kept.unionByName(closing)


def has_duration(duration: Column) -> Column:
    return F.coalesce(duration > 0, F.lit(False))


def running_median(energies: DataFrame, window: int = 7, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Replace ``energy`` by its centred median; the edge values are repeated outside the series."""
    if window < 3:
        return energies
    if window % 2 == 0:
        raise ValueError("the median window must be odd")
    half = window // 2
    haloed = with_halo(energies, FILE, "k", before=half, after=half, chunk_rows=chunk_rows)
    seen = F.collect_list("energy").over(chunk_window(FILE, "k").rowsBetween(-half, half))
    lead_pad = F.greatest(F.lit(half) - F.col("k"), F.lit(0)).cast("int")
    tail_pad = F.lit(window) - F.size("_seen") - lead_pad
    filled = F.concat(
        F.array_repeat(F.element_at("_seen", 1), lead_pad),
        F.col("_seen"),
        F.array_repeat(F.element_at("_seen", -1), tail_pad),
    )
    return (
        haloed.withColumn("_seen", seen)
        .where("_own")
        .withColumn("energy", F.array_sort(filled)[half])
        .select(*energies.columns)
    )


def noise_threshold(energies: DataFrame, sensitivity: float = 1.0) -> DataFrame:
    """Per file: ``n``, ``p5``, ``p20`` and the motion threshold; files with one energy only are FAILED."""
    return (
        percentiles(energies, FILE, "energy", {"p5": 0.05, "p20": 0.2})
        .withColumn("threshold", F.col("p5") + F.greatest(F.lit(0.5), F.lit(sensitivity) * ((F.col("p20") - F.col("p5")) * 2.5)))
        .withColumn("analysis_status", F.when(F.col("n") < 2, "FAILED").otherwise("ANALYZED"))
    )


def raw_labels(
    energies: DataFrame, thresholds: DataFrame, chunk_rows: int = CHUNK_ROWS, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Labels ``i`` = k + 1 with energy > threshold, after a leading False label at i = 0.

    The labels carry their ``_chunk``, so threshold join and run windows share one
    exchange of the rows.
    """
    usable = thresholds.where("analysis_status = 'ANALYZED'").select(*FILE, "n", "threshold")
    rows = energies.select(*FILE, (F.col("k") + 1).alias("i"), "energy", *carry)
    rows = rows.withColumn("_chunk", div(F.col("i"), chunk_rows))
    rows = attach(rows, usable, FILE, "i", F.col("n"), chunk_rows)
    label = lambda i, moving, energy: F.struct(
        i.cast("long").alias("i"), moving.alias("is_motion"), energy.alias("energy")
    )
    own = label(F.col("i"), F.col("energy") > F.col("threshold"), F.col("energy"))
    leading = F.when(F.col("i") == 1, label(F.lit(0), F.lit(False), F.lit(0.0)))
    return rows.select(*FILE, "_chunk", F.explode(F.array_compact(F.array(leading, own))).alias("_l"), *carry).select(
        *FILE, "_l.*", *carry, "_chunk"
    )


def label_runs(
    labels: DataFrame,
    min_motion: int = 3,
    min_static: int = 5,
    noise_suppress: int = 2,
    chunk_rows: int = CHUNK_ROWS,
    smooth: bool = True,
) -> DataFrame:
    """Runs of equal labels, smoothed: ``first_i``, ``last_i``, ``labels``, ``is_motion``, ``max_energy``, and
    the times of the first and last label if the labels have a ``time``.

    First too short motion runs become static and too short static runs become
    motion, judged by the raw runs; then static runs still too short become motion.
    """
    columns = {
        "last_i": "last",
        "labels": "sum",
        "is_motion": "same",
        "max_energy": "max",
    }
    rows = labels.withColumns(
        {"first_i": F.col("i"), "last_i": F.col("i"), "labels": F.lit(1).cast("long"), "max_energy": F.col("energy")}
    )
    if "time" in labels.columns:
        rows = rows.withColumns({"start_time": F.col("time"), "end_time": F.col("time")})
        columns |= {"start_time": "first", "end_time": "last"}

    def joined(df):
        return coalesce_runs(
            df, FILE, "first_i", columns, lambda prev, cur: prev("is_motion") != cur("is_motion"), chunk_rows
        )

    runs = joined(rows)
    if not smooth:
        return runs
    first = _by_raw_length(F.col("is_motion"), F.col("labels"), min_motion, noise_suppress)
    runs = joined(runs.withColumn("is_motion", first))
    still = F.col("is_motion") | (F.col("labels") < min_static)
    return joined(runs.withColumn("is_motion", still))


def smooth_labels(
    labels: DataFrame,
    min_motion: int = 3,
    min_static: int = 5,
    noise_suppress: int = 2,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The labels after smoothing, one row per label.

    Their runs are smoothed and then looked up per row.
    """
    plain = labels.drop("time") if "time" in labels.columns else labels
    runs = label_runs(plain, min_motion, min_static, noise_suppress, chunk_rows)
    return runs_to_rows(
        labels.drop("is_motion"), runs, FILE, "i", "first_i", "last_i", {"is_motion": "is_motion"}, chunk_rows
    ).select(*[c for c in labels.columns if c != "_chunk"])


def _by_raw_length(moving: Column, length: Column, min_motion: int, noise_suppress: int) -> Column:
    """The label after the first pass: too short motion runs are static, too short static runs motion."""
    return (
        F.when(moving & (length < min_motion), False).when(~moving & (length < noise_suppress), True).otherwise(moving)
    )


def motion_ratio(runs: DataFrame) -> DataFrame:
    """Per file: labels, motion labels, static labels and the share of motion."""
    moving = F.sum(F.when(F.col("is_motion"), F.col("labels")).otherwise(0))
    return runs.groupBy(*FILE).agg(
        F.sum("labels").alias("labels"),
        moving.alias("motion_labels"),
        (F.sum("labels") - moving).alias("static_labels"),
        (moving / F.sum("labels")).alias("motion_ratio"),
    )


def sampling_rate(
    duration: Column,
    fixed: float = 5.0,
    short: tuple[float, float] = (120.0, 5.0),
    medium: tuple[float, float] = (600.0, 2.0),
    long_rate: float = 1.0,
    adaptive: bool = True,
) -> Column:
    """Frames per second to look at, by length of the file; the fixed rate if the length is unknown."""
    if not adaptive:
        return F.lit(float(fixed))
    return (
        F.when(duration.isNull() | (duration <= 0), float(fixed))
        .when(duration <= short[0], float(short[1]))
        .when(duration <= medium[0], float(medium[1]))
        .otherwise(float(long_rate))
    )


def frame_stride(native_fps: Column, rate: Column) -> Column:
    """Every how many frames one is kept, at least 1; unknown native rates count as 30."""
    fps = F.when(native_fps > 0, native_fps).otherwise(30.0)
    return F.greatest(F.lit(1), F.bround(fps / rate).cast("int"))


def every_kth(frames: DataFrame, idx: str, stride: Column | int) -> DataFrame:
    """Keep the frames 0, stride, 2·stride, ...; a plain filter that stays next to the scan."""
    return frames.where(F.col(idx) % (F.lit(stride) if isinstance(stride, int) else stride) == 0)


def label_time(
    i: Column,
    last_i: Column,
    duration: Column,
    frames: Column,
    rate: Column,
    early: Column,
    offset: Column | None = None,
    axis: str = "compat",
) -> Column:
    """Time of a label. ``compat`` spreads the frames seen over the whole duration, ``true`` steps by 1/rate."""
    offset = F.lit(0.0) if offset is None else offset
    fps = F.when((duration > 0) & (frames > 0), frames / duration).otherwise(rate) if axis == "compat" else rate
    step = F.lit(1.0) / fps
    return F.when(early & (i == last_i), offset + duration).otherwise(offset + F.least(i * step, duration))


def analyze(
    energies: DataFrame,
    sensitivity: float = 1.0,
    median_window: int = 7,
    early_window: int | None = 20,
    early_threshold: float = 2.5,
    min_motion: int = 3,
    min_static: int = 5,
    noise_suppress: int = 2,
    files: DataFrame | None = None,
    axis: str = "compat",
    chunk_rows: int = CHUNK_ROWS,
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, label: df,
) -> DataFrame:
    """The whole chain from energies to smoothed runs with times.

    ``files`` has ``file_id``, ``duration`` and ``offset`` (seconds); labels of a file
    without a duration all lie at its offset. ``keep`` may store the series between the steps, which read it several times.
    """
    series = energies.select(*FILE, "k", "energy")
    if early_window:
        series = keep(cut_quiet_tail(series, early_window, early_threshold, chunk_rows, files), "cut")
    else:
        series = series.withColumn("early", F.lit(False))
    ended = series.groupBy(*FILE).agg(F.max("early").alias("early"), F.max("k").alias("last_k"))
    series = keep(running_median(series.drop("early"), median_window, chunk_rows), "median")
    labels = raw_labels(series, noise_threshold(series, sensitivity), chunk_rows)
    if files is None:
        return label_runs(labels, min_motion, min_static, noise_suppress, chunk_rows)
    axes = ended.join(files, FILE).select(
        *FILE,
        F.coalesce("duration", F.lit(0.0)).alias("duration"),
        "offset",
        "early",
        (F.col("last_k") + 1).alias("_last_i"),
        # frames looked at: one more than the energies before the appended zero
        (F.col("last_k") + F.when(F.col("early") & has_duration(F.col("duration")), 1).otherwise(2)).alias("_frames"),
    )
    timed = attach(labels, axes, FILE, "i", F.col("_last_i"), chunk_rows).withColumn(
        "time",
        label_time(
            F.col("i"),
            F.col("_last_i"),
            F.col("duration"),
            F.col("_frames"),
            sampling_rate(F.col("duration")),
            F.col("early"),
            F.col("offset"),
            axis,
        ),
    )
    return label_runs(timed.select(*labels.columns, "time"), min_motion, min_static, noise_suppress, chunk_rows)
