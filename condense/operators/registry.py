"""The clip registry and the day status as tables: inserts, updates, counts, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

DAY = ["date", "cam_index"]


def new_clips(found: DataFrame, registry: DataFrame) -> DataFrame:
    """Found clips whose path is not registered yet, each once."""
    return found.dropDuplicates(["path"]).join(registry.select("path"), "path", "left_anti")


def insert_new(registry: DataFrame, found: DataFrame) -> DataFrame:
    """The registry after an insert that ignores known paths."""
    return registry.unionByName(new_clips(found, registry), allowMissingColumns=True)


def latest(changes: DataFrame, keys: list[str], at: str, rank: str | None = None) -> DataFrame:
    """The newest change per key; pre-aggregated, so many changes of one key do not meet in one task.

    A change without a time is older than any with one. Of equally old ones the
    higher ``rank`` column wins (it is dropped), then a hash of the row decides.
    """
    others = [c for c in changes.columns if c not in keys and c != rank]
    order = F.struct(
        F.col(at).isNotNull().alias("timed"),
        F.col(at).alias("at"),
        (F.col(rank) if rank else F.lit(0)).alias("rank"),
        F.xxhash64(*others).alias("row"),
    )
    newest = F.max_by(F.struct(*others), order).alias("_c")
    return changes.groupBy(*keys).agg(newest).select(*keys, "_c.*")


def update(registry: DataFrame, changes: DataFrame, keys: list[str] = ["path"]) -> DataFrame:
    """Set the given columns for the given keys; NULL in a change leaves the old value.

    ``changes`` has one row per key. Keys not in the registry are ignored.
    """
    fields = [c for c in changes.columns if c not in keys]
    renamed = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = registry.join(renamed, keys, "left")
    return joined.select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in registry.columns]
    )


def upsert(table: DataFrame, changes: DataFrame, keys: list[str] = DAY, at: str = "updated_at") -> DataFrame:
    """Insert or overwrite by key: of the old row and all changes the newest stays, a change if both are as old."""
    both = table.withColumn("_rank", F.lit(0)).unionByName(changes.withColumn("_rank", F.lit(1)))
    return latest(both, keys, at, "_rank").select(*table.columns)


def of_day(table: DataFrame, date: str | None = None, cam: int | None = None) -> DataFrame:
    """Rows of one day; with a date and no camera, camera 0. A filter on the partition columns."""
    if date is None:
        return table
    return table.where((F.col("date") == date) & (F.col("cam_index") == (0 if cam is None else cam)))


def is_prescreen_pending() -> Column:
    return F.col("prescreen_status") == "PENDING"


def is_analysis_pending() -> Column:
    return (F.col("prescreen_status") == "SUSPICIOUS") & (F.col("analysis_status") == "PENDING")


def prescreen_pending(clips: DataFrame, retry_failed: bool = False) -> DataFrame:
    wanted = is_prescreen_pending()
    if retry_failed:
        wanted = wanted | (F.col("prescreen_status") == "FAILED")
    return clips.where(wanted)


def analysis_pending(clips: DataFrame) -> DataFrame:
    return clips.where(is_analysis_pending())


def in_clip_order(clips: DataFrame) -> DataFrame:
    """For a listing of one or more days: clips by start time within their day."""
    return clips.orderBy(*DAY, "file_start_time", "path")


def pending_counts(clips: DataFrame) -> DataFrame:
    """Per day: clips waiting for either stage, and whether each stage is complete."""
    first, second = F.count_if(is_prescreen_pending()), F.count_if(is_analysis_pending())
    return clips.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("clips"),
        first.alias("prescreen_pending"),
        second.alias("analysis_pending"),
        (first + second).alias("pending"),
        (first == 0).alias("prescreen_complete"),
        (second == 0).alias("analysis_complete"),
    )


def verdict_counts(clips: DataFrame) -> DataFrame:
    """Per day: clips with a verdict, by verdict."""
    is_ = lambda s: F.col("prescreen_status") == s
    return clips.groupBy(*DAY).agg(
        F.count_if(~is_prescreen_pending()).alias("done"),
        F.count_if(is_("STATIC")).alias("static"),
        F.count_if(is_("SUSPICIOUS")).alias("suspicious"),
        F.count_if(is_("FAILED")).alias("failed"),
    )


def day_list(clips: DataFrame) -> DataFrame:
    return clips.select(*DAY).distinct().orderBy(*DAY)


def route(clips: DataFrame) -> DataFrame:
    """Adds ``route``, the stage each clip enters next: prescreen, analysis, timeline or failed."""
    status, analysis = F.col("prescreen_status"), F.col("analysis_status")
    return clips.withColumn(
        "route",
        F.when(status == "PENDING", "prescreen")
        .when(status == "STATIC", "timeline")
        .when((status == "SUSPICIOUS") & (analysis == "PENDING"), "analysis")
        .when((status == "SUSPICIOUS") & (analysis == "ANALYZED"), "timeline")
        .otherwise("failed"),
    )


def day_actions(counts: DataFrame, day_status: DataFrame) -> DataFrame:
    """Per day: ``skip`` if completed with nothing pending, ``reopen`` if completed with something pending, else ``run``."""
    done = F.col("status") == "COMPLETED"
    return counts.join(day_status.select(*DAY, "status"), DAY, "left").withColumn(
        "action",
        F.when(done & (F.col("pending") == 0), "skip").when(done, "reopen").otherwise("run"),
    )


def run_outcome(day_status: DataFrame) -> DataFrame:
    """One row over all days: total, ok, failed, and days that were not run."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    total = F.count(F.lit(1))
    return day_status.agg(
        total.alias("total"),
        is_("COMPLETED").alias("ok"),
        is_("FAILED").alias("failed"),
        (total - is_("COMPLETED") - is_("FAILED")).alias("not_run"),
    )


def first_errors(errors: DataFrame, keys: list[str], order: list[str], text: str, first: int = 5) -> DataFrame:
    """The first errors of each key as one text; the rank filter runs before the shuffle too."""
    ranked = errors.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col("_rank") <= first)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.col(text).cast("string").alias("_t")))), lambda e: e["_t"])
    return kept.groupBy(*keys).agg(F.array_join(texts, "; ").alias("errors"))
