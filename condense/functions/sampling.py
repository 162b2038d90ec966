"""Which moments of a clip to look at, and what counts as a change there."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DEFAULT_DURATION = 300.0
# Below this mean brightness a picture is dark, and the rule for its threshold.
DARK_LUMA, DARK_FLOOR, DARK_FACTOR = 50.0, 1.5, 0.3


def known_duration(duration: Column) -> Column:
    """The duration, or 300 s where it is missing or 0."""
    return F.coalesce(F.nullif(duration, F.lit(0.0)), F.lit(DEFAULT_DURATION))


def seek_points(duration: Column, segments: int, margin: float = 0.5) -> Column:
    """Array of sample times: segments + 1 evenly spaced points kept ``margin`` off the end; [0] up to one second."""
    step = duration / F.lit(segments)
    points = F.transform(
        F.sequence(F.lit(0), F.lit(segments)),
        lambda i: F.greatest(F.least(i * step, duration - margin), F.lit(0.0)),
    )
    return F.when(duration <= 1.0, F.array(F.lit(0.0))).otherwise(points)


def stream_rate(duration: Column, segments: int) -> Column:
    """Frames per second of the low-rate decode of a whole clip."""
    span = F.greatest(duration, F.lit(1.0))
    return F.greatest(F.lit(1.0) / span, F.lit(float(segments)) / span)


def stream_frames(segments: int) -> int:
    """How many frames the low-rate decode yields at most."""
    return max(2, segments + 1)


def stream_point(i: Column, duration: Column, segments: int) -> Column:
    """Time of the i-th frame of the low-rate decode."""
    return F.least(i / stream_rate(duration, segments), duration)


def luma_threshold(luma: Column, base: Column | float) -> Column:
    """Change threshold for a picture of this brightness: dark pictures get a lower one."""
    base = base if isinstance(base, Column) else F.lit(float(base))
    dark = F.greatest(F.lit(DARK_FLOOR), base * DARK_FACTOR)
    return F.when(luma < DARK_LUMA, dark).otherwise(base)
