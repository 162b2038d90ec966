"""Roll-ups of operation metrics and resource samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from condense.operators.ranks import pick_ranks


def merge_maps(*maps: Column) -> Column:
    """One map of all entries; for equal keys the later map wins, whatever the session's duplicate-key policy."""
    merged = maps[0]
    for later in maps[1:]:
        old = F.map_filter(merged, lambda k, _: ~F.array_contains(F.map_keys(later), k))
        merged = F.map_concat(old, later)
    return merged


def stage_latency(records: DataFrame, keys: list[str] = ["stage"], value: str = "duration") -> DataFrame:
    """Count, total, average, nearest-rank p50 and p95, minimum and maximum per stage, to 2 digits.

    p50 is the value at position floor(n/2) of the sorted list, p95 at floor(0.95 n).
    """
    plain = records.groupBy(*keys).agg(
        F.count(value).alias("count"),
        F.sum(value).alias("total"),
        F.avg(value).alias("avg"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    ranked = pick_ranks(
        records,
        keys,
        value,
        {
            "p50": (0.5, lambda n: F.floor(n / 2).cast("long")),
            "p95": (0.95, lambda n: F.floor(n * F.lit(0.95)).cast("long")),
        },
    ).drop("n")
    figures = ["total", "avg", "p50", "p95", "min", "max"]
    return plain.join(ranked, keys, "left").select(*keys, "count", *[F.bround(c, 2).alias(c) for c in figures])


def samples_in_stages(stages: DataFrame, samples: DataFrame, host: list[str], slot: float = 600.0) -> DataFrame:
    """Every sample with every stage of its host that is open at that time, ends included.

    Times are seconds. Stages are laid over slots of time, so a sample only meets
    the stages of its own slot and a busy host is spread over its slots.
    """
    laid = stages.withColumn(
        "_slot", F.explode(F.sequence(F.floor(F.col("start_ts") / slot), F.floor(F.col("end_ts") / slot)))
    )
    return (
        samples.withColumn("_slot", F.floor(F.col("ts") / slot))
        .join(laid, [*host, "_slot"])
        .where(F.col("ts").between(F.col("start_ts"), F.col("end_ts")))
        .drop("_slot")
    )


def stage_resources(
    stages: DataFrame,
    samples: DataFrame,
    host: list[str],
    averages: list[str],
    peaks: list[str] = [],
    slot: float = 600.0,
) -> DataFrame:
    """Per stage and device: average of some metrics and peak of others while the stage was open; 0 without samples.

    ``stages`` has host, ``name``, ``start_ts``, ``end_ts``; ``samples`` has host,
    ``ts``, ``device``, ``metric``, ``value``.
    """
    met = samples_in_stages(stages, samples, host, slot)
    keys = [*host, "name", "start_ts", "end_ts"]
    cells = [F.avg(F.when(F.col("metric") == m, F.col("value"))).alias(f"avg_{m}") for m in averages]
    cells += [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(f"peak_{m}") for m in peaks]
    rolled = met.groupBy(*keys, "device").agg(*cells)
    names = [f"avg_{m}" for m in averages] + [f"peak_{m}" for m in peaks]
    return stages.join(rolled, keys, "left").select(
        *host,
        "name",
        "device",
        (F.col("end_ts") - F.col("start_ts")).alias("duration"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names],
    )


def total_duration(stages: DataFrame) -> DataFrame:
    return stages.agg(F.sum(F.col("end_ts") - F.col("start_ts")).alias("total_duration"))


def _settled(column: str, digits: int) -> Column:
    # the last bits of an average depend on the order of its sum: they are cut before they can tip the rounding
    return F.bround(F.bround(column, 8), digits).alias(column)


def _by_name(a: Column, b: Column) -> Column:
    # maps have no order of their own, so stages are compared by name and length
    later = (a["name"] > b["name"]) | ((a["name"] == b["name"]) & (a["duration"] > b["duration"]))
    same = (a["name"] == b["name"]) & (a["duration"] == b["duration"])
    return F.when(same, 0).when(later, 1).otherwise(-1)


def run_documents(
    records: DataFrame,
    stages: DataFrame,
    samples: DataFrame,
    run: list[str],
    averages: list[str],
    peaks: list[str] = [],
    records_path: str | None = None,
    slot: float = 600.0,
) -> DataFrame:
    """One nested row per run: its length, resources by stage and device, latencies by stage, and where its records are.

    ``records`` has the run, ``stage`` and ``duration``; ``stages`` and ``samples`` are
    those of ``stage_resources`` with the run as host. Records stay rows of their own
    table (``records_path``): a run may hold any number of them, and the document
    points to them. Lists are as long as a run has stages and devices. A run needs
    stages; one without records has no latencies. Times to 2 digits, resources to 1.
    """
    names = [f"avg_{m}" for m in averages] + [f"peak_{m}" for m in peaks]
    met = stage_resources(stages, samples, run, averages, peaks, slot)
    device = F.when(
        F.col("device").isNotNull(), F.struct("device", F.struct(*[_settled(c, 1) for c in names]).alias("figures"))
    )
    by_stage = met.groupBy(*run, "name", F.bround("duration", 2).alias("duration")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(device))).alias("devices")
    )
    resources = by_stage.groupBy(*run).agg(F.collect_list(F.struct("name", "duration", "devices")).alias("_stages"))
    lengths = stages.groupBy(*run).agg(F.bround(F.max("end_ts") - F.min("start_ts"), 2).alias("pipeline_duration"))
    latency = stage_latency(records, [*run, "stage"], "duration")
    figures = [c for c in latency.columns if c not in (*run, "stage")]
    summary = latency.groupBy(*run).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", F.struct(*figures))))).alias("perf_summary"),
        F.sum("count").alias("_count"),
    )
    return (
        lengths.join(resources, run)
        .join(summary, run, "left")
        .select(
            *run,
            "pipeline_duration",
            F.array_sort("_stages", _by_name).alias("monitor_summary"),
            "perf_summary",
            F.struct(F.lit(records_path).alias("path"), F.coalesce("_count", F.lit(0).cast("long")).alias("count")).alias("records"),
        )
    )
