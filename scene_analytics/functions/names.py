"""Names and indices that go with video files and frame folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A session folder: N, seven digits, a dash, twelve digits.
SESSION = "^N[0-9]{7}-[0-9]{12}$"
LEVELS = 10
VIDEO_TYPES = ("mp4", "avi", "mov", "mkv", "webm")
IMAGE_TYPES = ("jpg", "jpeg", "png", "bmp", "tiff", "tif")


def session_name(path: Column) -> Column:
    """The nearest session folder among the last path levels, as a video name; else the last level."""
    parts = F.split(F.rtrim(path, F.lit("/")), "/")
    near = F.slice(parts, F.greatest(F.size(parts) - LEVELS, F.lit(0)) + 1, LEVELS)
    found = F.element_at(F.filter(near, lambda p: p.rlike(SESSION)), F.when(F.exists(near, lambda p: p.rlike(SESSION)), -1))
    return F.concat(F.coalesce(found, F.element_at(parts, -1)), F.lit(".mp4"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def source_kind(path: Column, is_dir: Column) -> Column:
    """image_sequence for folders, video for known video types, null for what can't be opened."""
    return F.when(is_dir, "image_sequence").when(extension(path).isin(*VIDEO_TYPES), "video")


def duration(frame_count: Column, fps: Column) -> Column:
    return F.when(fps > 0, frame_count / fps).otherwise(F.lit(0.0))
