"""Pixel arithmetic on one frame or a pair of frames.

Frames held as arrays use built-in array functions. Frames held as BINARY (one
byte per value) use Arrow batches and NumPy; keep such batches small with
``spark.sql.execution.arrow.maxRecordsPerBatch``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def luma(pixels: Column) -> Column:
    """Mean of all values of a frame."""
    return F.aggregate(pixels, F.lit(0.0), lambda acc, x: acc + x) / F.size(pixels)


def total_abs_diff(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x)


def mean_abs_diff(a: Column, b: Column) -> Column:
    """Mean absolute difference of two frames; NULL if one is missing."""
    return total_abs_diff(a, b) / F.size(a)


def roi_box(width: int, height: int, roi: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
    """Pixel box (x, y, w, h) of four fractions, truncated."""
    x, y, w, h = roi
    return int(width * x), int(height * y), int(width * w), int(height * h)


def crop(pixels: Column, width: int, height: int, box: tuple[int, int, int, int]) -> Column:
    """Values of a one-channel frame (row by row) that lie in the box and in the frame."""
    x, y, w, h = box
    rows = range(y, min(y + h, height))
    kept = max(0, min(w, width - x))
    return F.concat(*[F.slice(pixels, r * width + x + 1, kept) for r in rows])


def crop_binary(pixels: Column, width: int, height: int, box: tuple[int, int, int, int]) -> Column:
    """The same for a BINARY frame: its bytes in the box, row by row."""
    x, y, w, h = box
    rows = range(y, min(y + h, height))
    kept = max(0, min(w, width - x))
    return F.concat(*[F.substring(pixels, r * width + x + 1, kept) for r in rows])


def roi_energy(prev: Column, cur: Column, box: tuple[int, int, int, int]) -> Column:
    """Absolute difference of two cropped frames over the nominal area of the box."""
    return total_abs_diff(cur, prev) / F.lit(float(box[2] * box[3]))


def _values(raw) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8).astype(np.float64)


@F.pandas_udf(T.DoubleType())
def luma_binary(pixels: pd.Series) -> pd.Series:
    return pixels.map(lambda raw: None if raw is None else float(_values(raw).mean()))


@F.pandas_udf(T.DoubleType())
def mean_abs_diff_binary(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [None if p is None or q is None else float(np.abs(_values(p) - _values(q)).mean()) for p, q in zip(a, b)],
        dtype="float64",
    )


def roi_energy_binary(width: int, height: int, box: tuple[int, int, int, int]):
    """Kernel for two BINARY gray frames: crop, absolute difference, over the nominal area."""
    x, y, w, h = box

    @F.pandas_udf(T.DoubleType())
    def kernel(prev: pd.Series, cur: pd.Series) -> pd.Series:
        def view(raw):
            return _values(raw).reshape(height, width)[y : y + h, x : x + w]

        return pd.Series(
            [
                None if p is None or q is None else float(np.abs(view(q) - view(p)).sum() / (w * h))
                for p, q in zip(prev, cur)
            ],
            dtype="float64",
        )

    return kernel
