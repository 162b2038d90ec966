"""Streaming jobs over the test tables, cut into several files that arrive one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from condense.operators import timeline as tl
from condense.plans import day_queries as dq, frame_queries as fq, registry_queries as rq
from condense.plans.bound import bound
from condense.session import shared_dir
from condense.sources.tables import read_days
from condense.streaming import folds, jobs, release, settle

DAY = ["date", "cam_index"]
SPLITS = 3


def arriving(df: DataFrame, label: str, *scatter: str) -> DataFrame:
    """The table as a stream of ``SPLITS`` files, one per micro-batch, rows scattered over them."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    split = F.pmod(F.xxhash64(*scatter), F.lit(SPLITS))
    df.withColumn("_split", split).repartitionByRange(SPLITS, "_split").drop("_split").write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def arriving_in_time(df: DataFrame, label: str, event_time: str, identity: list[str]) -> DataFrame:
    """The table as a stream of files in order of time, as a camera network delivers it.

    A row is up to a day late, so rows of neighbouring files overlap. Some rows
    come twice, some of these long after their time. A last file holds a single row of a much
    later time, by which the watermark passes all others.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    low, high = df.agg(F.min(F.unix_micros(event_time)), F.max(F.unix_micros(event_time))).first()
    day, dice = 86_400_000_000, F.xxhash64(*identity)
    sent = F.unix_micros(event_time) + F.pmod(dice, F.lit(day))
    place = F.floor((sent - low) * F.lit(SPLITS) / F.lit(max(1, high + day - low + 1))).cast("int")
    again = F.when(F.pmod(dice, F.lit(20)) == 0, F.array(place, F.least(place + 1, F.lit(SPLITS - 1)), F.lit(SPLITS - 1)))
    dealt = df.withColumn("_split", F.explode(F.coalesce(again, F.array(place))))
    for k in range(SPLITS):
        dealt.where(F.col("_split") == k).drop("_split").write.mode("append").parquet(path)
    last = df.orderBy(F.col(event_time).desc()).limit(1)
    later = {event_time: F.timestamp_micros(F.lit(high + 60 * day)), "date": F.lit("99991231")}
    last.withColumns(later).select(*df.columns).write.mode("append").parquet(path)
    # all part files of one write come together
    files = len(spark.read.schema(df.schema).parquet(path).inputFiles())
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, files // (SPLITS + 1))).parquet(path)


def finished(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream to its end into a table and read it."""
    spark = stream.sparkSession
    path = shared_dir(spark, label)
    jobs.to_table(stream, path, shared_dir(spark, f"{label}-checkpoint")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def with_total(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys)


@bound(
    "stream_intake",
    f"""WITH {rq._ORDERS} SELECT path, date, cam_index,
    CASE WHEN (length * 8) / (file_duration * 1000) < 500 THEN 'STATIC' ELSE 'PENDING' END AS prescreen_status
    FROM n WHERE file_duration IS NOT NULL""",
)
def stream_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch is judged ten minutes after the one before: young clips of the first are held and settle."""
    found = rq.order_listing(spark, sf_dir).select(*jobs.LISTED)
    registry = shared_dir(spark, "intake")
    moment = lambda n: F.expr(f"timestamp_ntz'{rq.AS_OF}' + make_dt_interval(0, 0, {10 * n}, 0)")
    job = jobs.intake_job(
        arriving(found, "listings", "path"),
        registry,
        shared_dir(spark, "held"),
        shared_dir(spark, "intake-checkpoint"),
        moment,
        min_kbps=500.0,
    )
    job.start().awaitTermination()
    schema = "path string, prescreen_status string, date string, cam_index int, batch long"
    return spark.read.schema(schema).parquet(registry).select("path", *DAY, "prescreen_status")


@bound("stream_dedup", f"WITH {dq._DAYS} SELECT DISTINCT date, cam_index, source_file FROM d")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a sighting of its clip; each clip is let through once."""
    sightings = dq.event_segments(spark, sf_dir).select(
        *DAY, "source_file", "seq_in_file", F.to_timestamp("file_start_time", "yyyyMMddHHmmss").alias("seen_at")
    )
    stream = arriving(sightings, "sightings", "seq_in_file").drop("seq_in_file")
    return finished(jobs.without_duplicates(stream, ["source_file"], "seen_at", "400 days"), "dedup").drop("seen_at")


@bound("stream_prescreen", fq.PRESCREEN_STREAM)
def stream_prescreen(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, _ = fq.embedding_frames(spark, sf_dir)
    stream = arriving(with_total(frames.select("file_id", "i", "pixels"), ["file_id"], "frames"), "frames", "file_id", "i")
    return finished(folds.prescreen_stream(stream, fq.LIMIT), "verdicts")


@bound("stream_merge", f"WITH {dq._DAYS},{dq._merged('d')} SELECT * FROM mg")
def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw segments, some late, some repeated, merged as the watermark passes them."""
    midnight = F.unix_micros(F.to_timestamp("date", "yyyyMMdd"))
    starts = F.timestamp_micros(midnight + F.round(F.col("start_time") * 1e6).cast("long"))
    segments = dq.event_segments(spark, sf_dir).withColumn("event_time", starts)
    stream = arriving_in_time(segments, "segments", "event_time", ["source_file", "seq_in_file"])
    return finished(release.merge_stream(stream), "merged")


@bound("stream_batches", dq.COMPLETION)
def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips as they are finished; what is left of a day goes out when nothing has joined it for a day."""
    clips = dq.event_clips(dq.event_segments(spark, sf_dir)).select(*DAY, "path", "done_at")
    # a tick a clip: the order of completion is the number of its last event, spread over the table's month
    timed = clips.withColumn("done_at", F.timestamp_micros(F.unix_micros(F.to_timestamp(F.lit("20260101"), "yyyyMMdd")) + F.col("done_at") * F.lit(1_000_000)))
    stream = arriving_in_time(timed, "done", "done_at", ["path"])
    return finished(release.batch_stream(stream, patience_hours=24.0 * 40), "batches")


@bound(
    "stream_reopen",
    f"""WITH {dq._TIMELINE} SELECT date, cam_index, seq, filepath, start_in_file, end_in_file, state, duration FROM tm""",
)
def stream_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments arrive in several batches; each batch rebuilds the days it touches."""
    segments = dq.event_segments(spark, sf_dir)
    clips = dq.event_clips(segments)
    busy = clips.where("prescreen_status = 'SUSPICIOUS'").select(*DAY, F.col("path").alias("source_file"))
    days = tl.day_segments(
        tl.static_segments(clips), segments.join(busy, [*DAY, "source_file"], "left_semi")
    )
    timelines = shared_dir(spark, "timelines")
    job = jobs.reopen_job(
        arriving(days, "day-segments", "source_file", "seq_in_file"),
        shared_dir(spark, "segment-store"),
        timelines,
        shared_dir(spark, "reopen-checkpoint"),
        days.schema,
        absorb=False,
    )
    job.start().awaitTermination()
    schema = (
        "date string, cam_index int, seq long, filepath string, start_in_file double, end_in_file double, state string, "
        "duration double"
    )
    return read_days(spark, timelines, schema)


@bound(
    "stream_settle",
    f"""WITH {rq._ORDERS}, k AS (SELECT path, age, o_custkey % 11 = 0 AS gone, o_custkey % 7 = 0 AS grown, length FROM l)
    SELECT path, CASE WHEN grown AND age < 15 THEN length + 1 ELSE length END AS length,
           CASE WHEN age >= 15 THEN 0 WHEN age = 14 OR (age >= 9 AND NOT grown) THEN 1 ELSE 15 - age END AS minutes
    FROM k WHERE age >= 15 OR NOT gone""",
)
def stream_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scans: all files; a minute later some have grown and some are gone; an hour later an empty one."""
    listed = rq.order_listing(spark, sf_dir)
    first = listed.select(*jobs.LISTED, F.lit(0).alias("_minute"))
    # only what isn't old enough is looked at again
    young = listed.where(F.col("o_orderkey") % 30 < 15)
    size = F.when(F.col("o_custkey") % 11 == 0, None).when(F.col("o_custkey") % 7 == 0, F.col("length") + 1).otherwise(F.col("length"))
    second = young.select("path", "modificationTime", size.alias("length"), F.lit(1).alias("_minute"))
    nothing = [F.lit(None).cast(first.schema[c].dataType).alias(c) for c in jobs.LISTED]
    third = spark.range(1).select(*nothing, F.lit(60).alias("_minute"))
    start = F.expr(f"timestamp_ntz'{rq.AS_OF}'").cast("timestamp")
    path = shared_dir(spark, "sights")
    for scan in (first, second, third):
        seen = F.timestamp_micros(F.unix_micros(start) + F.col("_minute").cast("long") * settle.MINUTE)
        scan.select(*jobs.LISTED, seen.alias("seen_at")).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    sights = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    done = finished(settle.settled_stream(sights), "settled")
    minutes = ((F.unix_micros("settled_at") - F.unix_micros(start)) / settle.MINUTE).cast("long")
    return done.select("path", "length", minutes.alias("minutes"))


class Chain:
    """Listing, verdict, segments and timeline of the clips behind the events, each a streaming job on the log of the one before."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.segments = dq.event_segments(spark, sf_dir)
        self.clips = dq.event_clips(self.segments)
        found = self.clips.select("path", F.lit(0).cast("timestamp").alias("modificationTime"), F.lit(1_000_000).cast("long").alias("length"))
        self.listings = arriving(found, "listings", "path")
        self.tables = {name: shared_dir(spark, name) for name in ("registry", "verdicts", "day-segments", "store", "timelines", "held")}
        self.checkpoints = {name: shared_dir(spark, f"{name}-checkpoint") for name in ("intake", "verdict", "segment", "timeline")}
        self.day_schema = tl.day_segments(tl.static_segments(self.clips), self.segments).schema

    def intake(self):
        return jobs.intake_job(self.listings, self.tables["registry"], self.tables["held"], self.checkpoints["intake"])

    def verdict(self):
        """Evidence of a clip is what its events show; the verdict of a clip reaches the log once."""
        evidence = self.clips.select("path", "prescreen_status", "file_start_time", "file_end_time")
        listed = jobs.changes_of(self.spark, self.tables["registry"], "path string, date string, cam_index int")
        work = lambda new: new.join(evidence, "path").select(*DAY, "path", "prescreen_status", "file_start_time", "file_end_time")
        return jobs.stage_job(listed, self.tables["verdicts"], self.checkpoints["verdict"], ["path"], work)

    def segment(self):
        """Static clips are one segment, suspicious ones those of their series."""
        schema = "date string, cam_index int, path string, prescreen_status string, file_start_time string, file_end_time string"
        judged = jobs.changes_of(self.spark, self.tables["verdicts"], schema)

        def work(new: DataFrame) -> DataFrame:
            busy = new.where("prescreen_status = 'SUSPICIOUS'").select(*DAY, F.col("path").alias("source_file"))
            both = tl.day_segments(tl.static_segments(new), self.segments.join(busy, [*DAY, "source_file"], "left_semi"))
            return both.withColumn("path", F.col("source_file"))

        return jobs.stage_job(judged, self.tables["day-segments"], self.checkpoints["segment"], ["path"], work)

    def timeline(self):
        made = jobs.changes_of(self.spark, self.tables["day-segments"], self.day_schema)
        identity = ["source_file", "seq_in_file"]
        return jobs.reopen_job(
            made, self.tables["store"], self.tables["timelines"], self.checkpoints["timeline"], self.day_schema, identity, absorb=False
        )

    def run(self, *names: str) -> None:
        for name in names:
            getattr(self, name)().start().awaitTermination()

    def result(self) -> DataFrame:
        return read_days(self.spark, self.tables["timelines"], TIMELINE)


TIMELINE = (
    "date string, cam_index int, seq long, filepath string, start_in_file double, end_in_file double, state string, "
    "duration double"
)
STAGES = ("intake", "verdict", "segment", "timeline")
_TIMELINE_SQL = f"WITH {dq._TIMELINE} SELECT date, cam_index, seq, filepath, start_in_file, end_in_file, state, duration FROM tm"


@bound("stream_chain", _TIMELINE_SQL)
def stream_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From listings to timelines without a batch step between."""
    chain = Chain(spark, sf_dir)
    chain.run(*STAGES)
    return chain.result()


@bound("stream_resume", _TIMELINE_SQL)
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain is stopped after each stage and started anew from the first one: every clip goes on where it stands."""
    chain = Chain(spark, sf_dir)
    for stop in range(1, len(STAGES) + 1):
        chain.run(*STAGES[:stop])
    return chain.result()
