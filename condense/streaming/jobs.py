"""Incremental jobs over tables: clip intake, duplicate suppression, rebuilding of days.

Every micro-batch writes under its own number and overwrites what an earlier
try of the same number left, so a job may be stopped and restarted anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import LongType, StructField, StructType

from condense.operators import registry as reg, timeline as tl
from condense.session import path_exists, written
from condense.sources import listing as ls
from condense.sources.tables import write_days

DAY = ["date", "cam_index"]
LISTED = ["path", "modificationTime", "length"]


def intake_job(
    listings: DataFrame,
    registry: str,
    held: str,
    checkpoint: str,
    as_of: Callable[[int], Column] = lambda batch: F.current_timestamp(),
    freeze_minutes: float = 10.0,
    min_kbps: float = 0.0,
    quarantine: str | None = None,
) -> DataStreamWriter:
    """Register listed clips once they have settled; clips whose stamps are no time go to ``quarantine``.

    Too young clips go into the ``held`` table and are judged again with every
    later batch. Known paths are ignored. The registry is a log by batch here;
    ``write_days`` lays it out by day. Start the returned writer.
    """

    def accept(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = batch.select(*LISTED)
        before = f"{held}/{number - 1}"
        if path_exists(spark, before):
            found = found.unionByName(spark.read.schema(found.schema).parquet(before))
        newest = reg.latest(found, ["path"], "modificationTime").select(*LISTED)
        judged = ls.classify(ls.clip_names(newest), as_of(number), freeze_minutes=freeze_minutes, min_kbps=min_kbps)
        judged.where("intake = 'frozen'").select(*LISTED).write.mode("overwrite").parquet(f"{held}/{number}")
        if quarantine is not None:
            judged.where("intake = 'quarantined'").select(*LISTED).write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        accepted = judged.where("intake = 'added'").drop("intake").withColumn("analysis_status", F.lit("PENDING"))
        if path_exists(spark, registry):
            known = spark.read.schema("path string, batch long").parquet(registry).where(F.col("batch") < number)
            accepted = reg.new_clips(accepted, known)
        accepted.write.mode("overwrite").parquet(f"{registry}/batch={number}")

    return listings.writeStream.foreachBatch(accept).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def without_duplicates(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Drop repeated keys that arrive within ``delay`` of event time; the state is bounded by that time."""
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def stage_job(
    changes: DataFrame, table: str, checkpoint: str, keys: list[str], work: Callable[[DataFrame], DataFrame]
) -> DataStreamWriter:
    """One stage of a chain: rows that the stage before has decided come in, ``work`` decides on them, ``table`` takes the result.

    ``table`` is a log by batch: ``changes_of`` reads it as the stream of the next stage. A batch that
    is tried again overwrites what its earlier try left. A key that comes again, because the stage before was
    stopped in the middle of a batch, has been decided and is passed over, so a chain may be stopped anywhere
    and goes on where each clip stands.
    """

    def decide(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        if number and path_exists(spark, table):
            schema = StructType([batch.schema[k] for k in keys] + [StructField("batch", LongType())])
            done = spark.read.schema(schema).parquet(table).where(F.col("batch") < number)
            new = new.join(done, keys, "left_anti")
        work(new).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return changes.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def changes_of(spark: SparkSession, table: str, schema: StructType | str) -> DataFrame:
    """The rows of a stage's log as they come; the log may not exist yet."""
    return spark.readStream.schema(schema).parquet(f"{table}/batch=*")


def reopen_job(
    segments: DataFrame,
    store: str,
    timelines: str,
    checkpoint: str,
    schema: StructType,
    identity: list[str] | None = None,
    **options,
) -> DataStreamWriter:
    """Keep arriving segments and rebuild the timelines of the days they belong to; other days stay untouched.

    With ``identity`` a segment that comes again counts once.
    """

    def rebuild(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.hint("rebalance", *DAY).write.mode("overwrite").partitionBy(*DAY).parquet(f"{store}/batch={number}")
        kept = spark.read.schema(schema).parquet(store)
        touched = spark.read.schema(schema).parquet(f"{store}/batch={number}").select(*DAY).distinct()
        days = kept.join(touched, DAY, "left_semi")
        if identity is not None:
            days = days.dropDuplicates([*DAY, *identity])
        timeline = tl.build_timeline(tl.in_order(days), keep=written, **options)
        write_days(timeline, timelines, "overwrite")

    return segments.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def to_table(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append the rows of a stream to a Parquet folder, exactly once."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
