"""Expressions of the edit list."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def start_in_file(start: Column, file_offset: Column) -> Column:
    return F.greatest(start - file_offset, F.lit(0.0))


def end_in_file(end: Column, file_offset: Column, in_start: Column, min_length: float = 0.1) -> Column:
    return F.greatest(end - file_offset, in_start + F.lit(float(min_length)))


def shown_length(
    state: Column,
    duration: Column,
    keyframe_interval: float = 30.0,
    keyframe_display: float = 0.5,
    min_display: float = 1.5,
) -> Column:
    """Length on screen: DYNAMIC as recorded, STATIC compressed but not below the minimum nor above its own length."""
    factor = max(keyframe_interval, 1.0) / max(keyframe_display, 0.1)
    compressed = F.least(F.greatest(duration / F.lit(factor), F.lit(float(min_display))), duration)
    return F.when(state == "DYNAMIC", duration).otherwise(compressed)


def speed(duration: Column, shown: Column) -> Column:
    return F.when(shown > 0, duration / shown).otherwise(1.0)


def audio_choice(state: Column, has_audio: Column) -> Column:
    """``SOURCE`` for DYNAMIC parts of files with sound, else ``SILENT`` of the shown length."""
    return F.when((state == "DYNAMIC") & F.coalesce(has_audio, F.lit(False)), "SOURCE").otherwise("SILENT")
