"""Clip and output names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The clip name format camera_start_end.mp4.
CLIP_NAME = r"^(\d{2})_(\d{14})_(\d{14})\.mp4$"
OUTPUT_NAME = "DailyVlog_{date}_cam{index}.mp4"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_clip_name(name: Column) -> Column:
    return name.rlike(CLIP_NAME)


# The parts of a name that has the format stand at fixed places.


def clip_camera(name: Column) -> Column:
    return F.substring(name, 1, 2).cast("int")


def clip_start(name: Column) -> Column:
    return F.substring(name, 4, 14)


def clip_end(name: Column) -> Column:
    return F.substring(name, 19, 14)


def output_name(date: Column, cam: Column, template: str = OUTPUT_NAME) -> Column:
    dated = F.replace(F.lit(template), F.lit("{date}"), date)
    return F.replace(dated, F.lit("{index}"), cam.cast("string"))
