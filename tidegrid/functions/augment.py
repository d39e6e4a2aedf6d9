"""Augmentations with a fixed value, and a wrapper that draws the value per row.

Every draw is a hash of the row's key and a seed, so the same rows augment alike on any cluster.
Ranges of whole numbers include both ends. Temporal kernels take and return array<double>,
spectral ones array<array<double>> [frequency][time]; shapes do not change.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.functions.signal import by_length, let
from tidegrid.functions.spectral import on_spectrograms, resize


def uniform(key: Column, seed: int, salt: str) -> Column:
    """Uniform number in [0, 1) from a row's key."""
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(salt)), F.lit(1 << 52)) / float(1 << 52)


def ramp_volume(clip: Column, db: Column) -> Column:
    """Linear ramp from ``10^(-|db|/20)`` up to 1, or down to it for negative ``db``."""
    factor = F.pow(F.lit(10.0), -F.abs(db) / 20)
    first, last = F.when(db >= 0, factor).otherwise(1.0), F.when(db >= 0, F.lit(1.0)).otherwise(factor)
    steps = F.greatest(F.size(clip) - 1, F.lit(1))
    ends = F.struct(first.alias("a"), ((last - first) / steps).alias("d"))
    return let(ends, lambda e: F.transform(clip, lambda v, i: v * (e["a"] + e["d"] * i)))


def add_echo(clip: Column, delay_s: Column, level_db: Column, fs: float, inverted: Column | None = None) -> Column:
    """Clip plus itself delayed, scaled by the level and the clip's peak, perhaps inverted."""
    peak = F.array_max(F.transform(clip, lambda v: F.abs(v)))
    scale = F.pow(F.lit(10.0), level_db / 20) * peak
    if inverted is not None:
        scale = F.when(inverted, -scale).otherwise(scale)
    shift = F.least(F.rint(delay_s * fs).cast("int"), F.size(clip))
    late = F.concat(F.array_repeat(F.lit(0.0), shift), F.slice(clip, F.lit(1), F.size(clip) - shift))
    return let(scale, lambda k: F.zip_with(clip, late, lambda a, b: a + k * b))


def alter_distance(spec: Column, db: Column) -> Column:
    """Add a line from 0 at the lowest frequency to ``db`` at the highest."""
    steps = F.greatest(F.size(spec) - 1, F.lit(1))
    return F.transform(spec, lambda row, i: F.transform(row, lambda v: v + db * i / steps))


def gaussian_noise(db: float, seed: int):
    """Column function (key, clip): noise with deviation ``10^(-|db|/20) / 3`` of the peak."""

    @F.pandas_udf("array<double>")
    def run(keys: pd.Series, clips: pd.Series) -> pd.Series:
        out = []
        for key, clip in zip(keys, clips, strict=True):
            if clip is None:
                out.append(None)
                continue
            x = np.asarray(clip, float)
            deviation = 10 ** (-abs(db) / 20) / 3 * (np.abs(x).max() if len(x) else 0)
            out.append(x + np.random.default_rng([seed, int(key) & 0xFFFFFFFF, int(key) >> 32 & 0xFFFFFFFF]).normal(0, deviation, len(x)))
        return pd.Series(out)

    return run


def _stretch(x: np.ndarray, factor: float) -> np.ndarray:
    n = x.shape[1]
    diff = int(factor * n) - n
    if diff == 0:
        return x
    if diff < 0:
        long = resize(x[:, None, :], 1, n - diff)[:, 0]
        at = -diff // 2
        return long[:, at : at + n]
    half = diff // 2
    return resize(np.pad(x, ((0, 0), (half, diff - half)), mode="symmetric")[:, None, :], 1, n)[:, 0]


def shift_pitch(factor: float):
    """Column function: pitch up (> 1, padded and shrunk) or down (< 1, stretched and cropped)."""

    @F.pandas_udf("array<double>")
    def run(clips: pd.Series) -> pd.Series:
        return by_length(clips, lambda x: _stretch(x, factor))

    return run


def smear(x: np.ndarray, by: int, axis: int) -> np.ndarray:
    """Stretch along an axis by |by| cells and crop the far side (the near one for negative values)."""
    if by == 0:
        return x
    n = abs(by)
    size = [x.shape[0], x.shape[1]]
    size[axis] += n
    wide = resize(x, *size)
    first = 0 if by > 0 else n
    return np.take(wide, np.arange(first, first + x.shape[axis]), axis=axis)


def squish(x: np.ndarray, by: int, axis: int) -> np.ndarray:
    """Pad |by| mirrored cells on one side (the far one for negative values) and shrink back."""
    if by == 0:
        return x
    pad = [(0, 0), (0, 0)]
    pad[axis] = (0, -by) if by < 0 else (by, 0)
    return resize(np.pad(x, pad, mode="symmetric"), *x.shape)


def smear_frequency(by: int):
    return on_spectrograms(lambda x: smear(x, by, 0))


def smear_time(by: int):
    return on_spectrograms(lambda x: smear(x, by, 1))


def squish_frequency(by: int):
    return on_spectrograms(lambda x: squish(x, by, 0))


def squish_time(by: int):
    return on_spectrograms(lambda x: squish(x, by, 1))


def sometimes(key: Column, seed: int, probability: float, changed: Column, plain: Column) -> Column:
    """The changed value for a ``probability`` share of rows."""
    return F.when(uniform(key, seed, "apply") <= probability, changed).otherwise(plain)


def chain(clip: Column, key: Column, seed: int, steps: list[tuple[float, Callable[[Column, Column], Column]]]) -> Column:
    """Apply each (probability, function of (value, draw)) in turn, with a draw of its own."""


    def staged(i: int, probability: float, step):
        return lambda c: F.when(uniform(key, seed, f"apply{i}") <= probability, step(c, uniform(key, seed, f"value{i}"))).otherwise(c)

    # each stage is bound once, so that a chain costs the sum of its stages
    for i, (probability, step) in enumerate(steps):
        clip = let(clip, staged(i, probability, step))
    return clip
