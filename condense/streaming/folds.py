"""Streaming form of prescreening; merging and batching are in ``release``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, types as T

from condense.functions.sampling import DARK_FACTOR, DARK_FLOOR, DARK_LUMA
from condense.streaming.ordered import ordered_fold

VERDICT = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("max_diff", T.DoubleType()),
    T.StructField("checked_pairs", T.LongType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("mean_luma", T.DoubleType()),
    T.StructField("early_stop", T.BooleanType()),
])


def _keyed(stream: DataFrame, keys: list[str], *more: T.StructField) -> T.StructType:
    return T.StructType([stream.schema[k] for k in keys] + list(more))


def prescreen_stream(
    frames: DataFrame, threshold: float = 6.0, mode: str = "stream_fps", forget_after_ms: int | None = None
) -> DataFrame:
    """Verdicts as frames arrive: a clip is decided at its first change over the threshold, without waiting for the rest.

    ``frames`` has ``file_id``, ``i``, ``frames`` (how many the clip has) and
    ``pixels``. Kept in state: the first and the previous frame.
    """

    def limit(luma: float) -> float:
        return max(DARK_FLOOR, threshold * DARK_FACTOR) if luma < DARK_LUMA else threshold

    def step(memory, row, is_last):
        cur = np.asarray(row["pixels"], dtype=np.float64)
        luma = float(cur.mean())
        if memory is None:
            made = [("FAILED", None, 0, threshold if mode == "stream_fps" else limit(luma), None, False)] if is_last else []
            return (cur, cur, None, 0), made, is_last
        first, prev, biggest, pairs = memory
        change = max(float(np.abs(cur - prev).mean()), float(np.abs(cur - first).mean()))
        biggest, pairs = change if biggest is None else max(biggest, change), pairs + 1
        if change > limit(luma):
            return None, [("SUSPICIOUS", biggest, pairs, limit(luma), luma, True)], True
        if is_last:
            final = threshold if mode == "stream_fps" else limit(luma)
            status = "SUSPICIOUS" if biggest > final else "STATIC"
            return None, [(status, biggest, pairs, final, None, False)], True
        return (first, cur, biggest, pairs), [], False

    output = _keyed(frames, ["file_id"], *VERDICT.fields)
    return ordered_fold(frames, ["file_id"], "i", "frames", lambda: None, step, output, forget_after_ms)
