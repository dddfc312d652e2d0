"""Colour to intensity, 8-bit in and out: as expressions, and the same for arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gray(b: Column, g: Column, r: Column) -> Column:
    """Luma, rounded to a whole level."""
    return F.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5).cast("int")


def _linear(c: Column) -> Column:
    x = c / F.lit(255.0)
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def lightness(b: Column, g: Column, r: Column) -> Column:
    """CIE L* of sRGB, scaled to 0..255 and rounded to a whole level."""
    y = 0.212671 * _linear(r) + 0.715160 * _linear(g) + 0.072169 * _linear(b)
    star = F.when(y > 0.008856, 116 * F.cbrt(y) - 16).otherwise(903.3 * y)
    return F.floor(star * 255 / 100 + 0.5).cast("int")


def gray_array(b: np.ndarray, g: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5).astype(np.uint32)


_LEVELS = np.arange(256) / 255.0
_LINEAR = np.where(_LEVELS <= 0.04045, _LEVELS / 12.92, ((_LEVELS + 0.055) / 1.055) ** 2.4)


def lightness_array(b: np.ndarray, g: np.ndarray, r: np.ndarray) -> np.ndarray:
    y = 0.212671 * _LINEAR[r] + 0.715160 * _LINEAR[g] + 0.072169 * _LINEAR[b]
    star = np.where(y > 0.008856, 116 * np.cbrt(y) - 16, 903.3 * y)
    return np.floor(star * 255 / 100 + 0.5).astype(np.uint32)


def reorder(df: DataFrame, order: str = "rgb") -> DataFrame:
    """`df` with its channel columns (b, g, r and maybe a) in the named order behind the others; grey tables stay as they are.

    Channels that are neither one nor three nor four raise an error.
    """
    channels = [c for c in df.columns if c in "bgra"]
    if channels and (len(channels) < 3 or not set("bgr") <= set(channels)):
        raise ValueError(f"channels are {channels}")
    wanted = [c for c in order if c in channels] + [c for c in channels if c not in order]
    return df.select(*[c for c in df.columns if c not in channels], *wanted)
