"""Listing clip folders and classifying what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from condense.functions.clock import stamp_to_epoch
from condense.functions.names import base_name, clip_camera, clip_end, clip_start, is_clip_name

STABLE_MINUTES = 5  # fixed value: width of the age range in which the size is checked twice


def list_files(spark: SparkSession, folder: str, pattern: str = "*.mp4") -> DataFrame:
    """Path, change time and length of the files of a folder; their content is never read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", "modificationTime", "length")
    )


def stream_files(spark: SparkSession, folder: str, pattern: str = "*.mp4") -> DataFrame:
    return (
        spark.readStream.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", "modificationTime", "length")
    )


def clip_names(listing: DataFrame, local_time: bool = False) -> DataFrame:
    """Clips by name: camera, date, stamps, duration. Other names are dropped; stamps that are no
    time have a NULL duration.
    """
    name = base_name(F.col("path"))
    named = listing.where(is_clip_name(name)).select(
        *listing.columns,
        clip_camera(name).alias("cam_index"),
        F.substring(clip_start(name), 1, 8).alias("date"),
        clip_start(name).alias("file_start_time"),
        clip_end(name).alias("file_end_time"),
    )
    length = stamp_to_epoch(F.col("file_end_time"), local_time) - stamp_to_epoch(F.col("file_start_time"), local_time)
    return named.withColumn("file_duration", length)


def kbps(length: Column, duration: Column) -> Column:
    return (length * 8) / (duration * 1000)


def classify(
    clips: DataFrame,
    as_of: Column,
    second_look: DataFrame | None = None,
    skip_today: bool = False,
    freeze_minutes: float = 10.0,
    min_kbps: float = 0.0,
) -> DataFrame:
    """Adds ``intake`` and, for accepted clips, the first verdict.

    ``intake`` is ``quarantined`` (stamps are no time), ``skipped`` (today's),
    ``frozen`` (too young, or its size still changes) or ``added``. ``as_of`` is
    the moment of the scan; ``second_look`` a later listing (``path``, ``length``)
    that is consulted for files just above the age limit.
    """
    readable = F.col("file_duration").isNotNull()
    age = (as_of.cast("timestamp").cast("double") - F.col("modificationTime").cast("timestamp").cast("double")) / 60
    rows = clips.withColumn("_age", age)
    near = F.coalesce(F.lit(freeze_minutes > 0) & (F.col("_age") < freeze_minutes + STABLE_MINUTES), F.lit(False))
    moved = F.lit(False)
    if second_look is not None and not skip_today and freeze_minutes > 0:
        # only the slice of young files is looked at twice; all others pass by the join
        again = second_look.select("path", F.col("length").alias("_length2"))
        young = rows.where(near).join(again, "path", "left")
        changed = F.col("_length2").isNull() | (F.col("_length2") != F.col("length"))
        rows = rows.where(~near).withColumn("_moved", F.lit(False)).unionByName(
            young.withColumn("_moved", F.coalesce(changed, F.lit(True))).drop("_length2")
        )
        moved = F.col("_moved")
    frozen = F.lit(False) if skip_today else (F.col("_age") < freeze_minutes) | (near & moved)
    today = F.lit(skip_today) & (F.col("date") == F.date_format(as_of, "yyyyMMdd"))
    rate = kbps(F.col("length"), F.col("file_duration"))
    low = F.lit(min_kbps > 0) & (F.col("file_duration") > 0) & (rate < min_kbps)
    reason = F.to_json(F.struct(F.lit("low_bitrate").alias("reason"), F.bround(rate, 1).alias("kbps")))
    added = F.col("intake") == "added"
    return rows.withColumn(
        "intake",
        F.when(~readable, "quarantined").when(today, "skipped").when(frozen, "frozen").otherwise("added"),
    ).select(
        *clips.columns,
        "intake",
        F.when(added, F.when(low, "STATIC").otherwise("PENDING")).alias("prescreen_status"),
        F.when(added & low, reason).alias("prescreen_result"),
    )


def intake_counts(classified: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """One row: added, skipped, frozen, quarantined, and how many accepted clips were known already."""
    rows = classified.withColumn("_known", F.lit(False))
    if registry is not None:
        known = registry.select("path", F.lit(True).alias("_known"))
        rows = classified.join(known, "path", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    is_ = lambda s: F.col("intake") == s
    return rows.agg(
        F.count_if(is_("added") & ~F.col("_known")).alias("added"),
        F.count_if(is_("added") & F.col("_known")).alias("known"),
        F.count_if(is_("skipped")).alias("skipped"),
        F.count_if(is_("frozen")).alias("frozen"),
        F.count_if(is_("quarantined")).alias("quarantined"),
    )
