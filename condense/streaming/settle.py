"""The lateness gate as a stream: a file is let through once it has settled.

Every scan reports the files it saw, each with the time of the scan. A state holds a block of paths, for each its last
size, how often that was seen and the time of the change. A file that is old enough passes at once, one
that is nearly so passes when two sights show the same size, and the rest is held. A time-out on the
watermark of the scans judges a held file without any news of it: nobody saw it change until it was old
enough, so it has settled; a file that a scan found gone is forgotten.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from condense.session import ship
from condense.sources.listing import STABLE_MINUTES
from condense.streaming.release import MS, with_state_store

MINUTE = 60_000_000

SETTLED = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("changed_us", T.LongType()),
    T.StructField("settled_us", T.LongType()),
])


#: Blocks of paths, each one state: a state a path costs some milliseconds whatever it holds.
BLOCKS = 2_048

#: Per path of a block its last size, the time of the change, how often that was seen, whether it passed and until when this holds.
STATE = "body binary"


def settle_block(freeze: int, forget: int):
    """Two sights of a path, and a time-out for the time from which it counts as settled, for the paths of a block."""
    settled = freeze + STABLE_MINUTES * MINUTE

    def look(sight: tuple | None, at: int, changed: int, length: int) -> tuple[tuple, bool]:
        """What is known after a look at a file, and whether it passes by that."""
        same = sight is not None and sight[:2] == (length, changed)
        if same and sight[3]:
            return (*sight[:4], at + forget), False
        looks, age = sight[2] + 1 if same else 1, at - changed
        passed = age >= settled or (age >= freeze and looks > 1)
        return (length, changed, looks, passed, at + forget if passed else changed + settled), passed

    def judge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sights: dict[str, tuple] = pickle.loads(state.get[0]) if state.exists else {}
        out: list[tuple] = []
        news: list[tuple] = []
        if not state.hasTimedOut:
            for pdf in parts:
                columns = [pdf[c].tolist() for c in ("path", "seen_us", "gone", "changed_us", "length")]
                # a scan's word that it saw nothing has no path; a filter would drop it before it moves the watermark
                news += [row for row in zip(*columns) if row[0] is not None]
        for path, at, gone, changed, length in sorted(news):
            if gone:
                sights.pop(path, None)
                continue
            sights[path], passed = look(sights.get(path), at, changed, length)
            if passed:
                out.append((path, length, changed, at))
        watermark = state.getCurrentWatermarkMs()
        for path, (length, changed, looks, passed, until) in list(sights.items()):
            if until > watermark * MS:
                continue
            if not passed:  # let through, and remembered for a while
                out.append((path, length, changed, until))
                until += forget
                sights[path] = (length, changed, looks, True, until)
            if until <= watermark * MS:
                del sights[path]
        if sights:
            state.update((pickle.dumps(sights),))
            state.setTimeoutTimestamp(-(-min(s[4] for s in sights.values()) // MS))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=SETTLED.fieldNames())

    return judge


def settled_stream(
    sights: DataFrame, freeze_minutes: float = 10.0, delay: str = "30 seconds", forget_days: float = 1.0, blocks: int = BLOCKS
) -> DataFrame:
    """Files of ``sights`` that have settled: ``path``, ``length``, ``modificationTime`` and ``settled_at``, each once per size.

    ``sights`` has ``path``, ``modificationTime``, ``length`` (NULL: looked for and gone) and ``seen_at``, the time of
    the scan. A scan that saw nothing reports one row with a NULL path, so that time goes on. A file
    that changes after it was let through, or comes back after ``forget_days``, is let through again; the registry ignores known paths.
    """
    ship(sights.sparkSession)
    with_state_store(sights.sparkSession)
    timed = sights.withColumn("seen_at", F.col("seen_at").cast("timestamp")).withWatermark("seen_at", delay)
    rows = timed.select(
        F.pmod(F.xxhash64("path"), F.lit(blocks)).alias("block"),
        "path",
        F.col("length").isNull().alias("gone"),
        F.coalesce(F.col("length").cast("long"), F.lit(0)).alias("length"),
        F.coalesce(F.unix_micros(F.col("modificationTime").cast("timestamp")), F.lit(0)).alias("changed_us"),
        F.unix_micros("seen_at").alias("seen_us"),
        "seen_at",
    )
    judge = settle_block(round(freeze_minutes * MINUTE), round(forget_days * 1440 * MINUTE))
    found = rows.groupBy("block").applyInPandasWithState(judge, SETTLED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(
        "path", "length", F.timestamp_micros("changed_us").alias("modificationTime"), F.timestamp_micros("settled_us").alias("settled_at")
    )
