"""Time expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from condense.functions.doubles import two_places

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_micros(ts: Column) -> Column:
    """Microseconds of a zone-less timestamp since 1970, whatever the session zone."""
    gap = ts - F.expr(_EPOCH)
    days, hours, minutes, seconds = (F.extract(F.lit(p), gap) for p in ("DAY", "HOUR", "MINUTE", "SECOND"))
    whole = (days.cast("long") * 24 + hours) * 60 + minutes
    return whole * 60_000_000 + (seconds * 1_000_000).cast("long")


def epoch_seconds(ts: Column) -> Column:
    return epoch_micros(ts) / F.lit(1e6)


def stamp_to_epoch(text: Column, local: bool = False) -> Column:
    """Epoch seconds of a clip stamp ``yyyyMMddHHmmss``, read as UTC or in the session zone; NULL if it is no time."""
    part = lambda at, n: F.substring(text, at, n)
    iso = F.concat(
        part(1, 4), F.lit("-"), part(5, 2), F.lit("-"), part(7, 2), F.lit(" "), part(9, 2), F.lit(":"), part(11, 2),
        F.lit(":"), part(13, 2), F.lit("" if local else "Z"),
    )
    return F.unix_seconds(iso.try_cast("timestamp")).cast("double")


def day_offset(stamp: Column, date: Column, clamp: bool = False, local: bool = False) -> Column:
    """Seconds from the midnight of ``date`` (yyyyMMdd) to ``stamp``."""
    offset = stamp_to_epoch(stamp, local) - stamp_to_epoch(F.concat(date, F.lit("000000")), local)
    return F.greatest(offset, F.lit(0.0)) if clamp else offset


def minutes_seconds(t: Column) -> Column:
    """``m:ss.ss``."""
    return F.format_string("%d:%s", F.floor(t / 60).cast("long"), two_places(F.pmod(t, F.lit(60.0)), 5))
