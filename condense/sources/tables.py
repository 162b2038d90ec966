"""Day-partitioned tables, label files and metric files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from condense.functions.clock import minutes_seconds
from condense.functions.doubles import two_places
from condense.operators.registry import of_day, update

DAY = ["date", "cam_index"]


def write_days(table: DataFrame, path: str, mode: str = "append") -> None:
    """Write partitioned by day. Mode ``overwrite`` replaces only the days present in ``table``.

    Rows are gathered by day so that a day has few files; AQE splits large days again.
    """
    (
        table.hint("rebalance", *DAY)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*DAY)
        .parquet(path)
    )


def read_days(
    spark: SparkSession, path: str, schema: T.StructType | str, date: str | None = None, cam: int | None = None
) -> DataFrame:
    """Read the table, or one day of it: a filter on the partition columns, so other days are not listed as input."""
    return of_day(spark.read.schema(schema).parquet(path), date, cam)


def in_days(days: list[tuple[str, int]]) -> Column:
    """Whether a row is of one of these days; a filter on the partition columns, one list of dates per camera."""
    dates: dict[int, list[str]] = {}
    for date, cam in days:
        dates.setdefault(cam, []).append(date)
    picked = F.lit(False)
    for cam, listed in sorted(dates.items()):
        picked = picked | ((F.col("cam_index") == cam) & F.col("date").isin(*sorted(listed)))
    return picked


def update_days(
    spark: SparkSession, path: str, schema: T.StructType | str, changes: DataFrame, keys: list[str] = ["path"]
) -> int:
    """Set fields of rows of a day-partitioned table; only the days that hold changed keys are read and written.

    ``changes`` has the day and ``keys``, one row per key, and the fields to set;
    NULL leaves the old value, unknown keys are ignored. The touched days (their names
    only) go through the driver. A day is replaced as a whole when the job commits,
    so a job that fails leaves the table as it was. Returns the number of days written.
    """
    fields = [c for c in changes.columns if c not in (*DAY, *keys)]
    days = [tuple(r) for r in changes.dropna(subset=DAY).select(*DAY).distinct().collect()]
    touched = spark.read.schema(schema).parquet(path).where(in_days(days))
    present = [tuple(r) for r in touched.select(*DAY).distinct().collect()]
    if present:
        write_days(update(touched, changes.select(*DAY, *keys, *fields), [*DAY, *keys]), path, "overwrite")
        spark.catalog.refreshByPath(path)
    return len(present)


def write_label_csv(labels: DataFrame, path: str, per_file: bool = False) -> None:
    """The motion labels as CSV: file, index, time with two digits, 1, and ``m:ss.ss``.

    ``per_file`` writes a folder per file instead of a column, for a few files
    that people look at.
    """
    rows = labels.where("is_motion").select(
        F.col("i").alias("frame_index"),
        two_places(F.col("time")).alias("time_sec"),
        F.lit(1).alias("is_motion"),
        minutes_seconds(F.col("time")).alias("formatted_time"),
        "file_id",
    )
    if per_file:
        rows.hint("rebalance", "file_id").write.partitionBy("file_id").option("header", True).csv(path)
    else:
        rows.write.option("header", True).csv(path)


LABEL_CSV = T.StructType([
    T.StructField("frame_index", T.LongType()),
    T.StructField("time_sec", T.StringType()),
    T.StructField("is_motion", T.IntegerType()),
    T.StructField("formatted_time", T.StringType()),
    T.StructField("file_id", T.LongType()),
])


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    """Operation metrics as JSON lines, a folder per day; summaries are queries over it."""
    metrics.hint("rebalance", *DAY).write.partitionBy(*DAY).json(path)


def write_run_documents(documents: DataFrame, path: str) -> None:
    """One JSON document per run; Spark's commit shows all of them or none, and an earlier folder is not overwritten."""
    documents.write.mode("errorifexists").json(path)
