"""Fixed-length sliding clips over an ordered sample axis.

A clip starts at 0, A, 2A, ... while it fits into the recording of N samples; N < L gives none. The
optional trailing clip covers the last L samples when at least ``min(L // 2, L - A)`` samples, and
more than none, are left over; its start is exactly ``N - L``. Null lengths give no clips, repeated
recordings are one. Grids are made by arithmetic (no shuffle but the distinct one).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ClipSettings:
    """Sampling rate, clip length and advance in seconds; lengths in samples are rounded half-even."""

    fs: int
    clip_length_s: float
    clip_advance_s: float
    trailing: bool = False
    normalize: bool = True
    filterspec: tuple | None = None

    def __post_init__(self):
        if not 0 < self.clip_advance_s <= self.clip_length_s:
            raise ValueError("the advance must be positive and at most the clip length")

    @property
    def length(self) -> int:
        return int(round(self.clip_length_s * self.fs))

    @property
    def advance(self) -> int:
        return int(round(self.clip_advance_s * self.fs))


def recordings_axis(recordings: DataFrame, fs: int) -> DataFrame:
    """(file, channel, n): distinct recordings with their number of samples at ``fs``."""
    own = recordings.select("file", "channel", F.expr(f"n_samples * {fs} div fs").alias("n"))
    return own.dropna().groupBy("file", "channel").agg(F.max("n").alias("n"))


def has_trailing(n: Column, s: ClipSettings) -> Column:
    """Does a recording of ``n`` samples leave enough behind its last regular clip?"""
    left = F.pmod(n - s.length, F.lit(s.advance).cast("bigint"))
    return (n >= s.length) & (left > 0) & (left >= min(s.length // 2, s.length - s.advance))


def clip_starts(n: Column, s: ClipSettings) -> Column:
    """Array of the start samples of all clips of a recording of ``n`` samples."""
    length, advance = F.lit(s.length).cast("bigint"), F.lit(s.advance).cast("bigint")
    regular = F.sequence(F.lit(0).cast("bigint"), F.floor((n - length) / advance) * advance, advance)
    if s.trailing:
        regular = F.when(has_trailing(n, s), F.concat(regular, F.array(n - length))).otherwise(regular)
    return F.when(n >= length, regular).otherwise(F.array().cast("array<bigint>"))


def clip_grid(axis: DataFrame, s: ClipSettings) -> DataFrame:
    """(file, channel, clip_idx, clip_start, clip_end) of all clips; ends are inclusive."""
    out = axis.select("file", "channel", F.posexplode(clip_starts(F.col("n"), s)).alias("clip_idx", "clip_start"))
    return out.withColumn("clip_end", F.col("clip_start") + (s.length - 1))


def clip_counts(axis: DataFrame, s: ClipSettings) -> DataFrame:
    """(file, n_clips), channels added up, without building the clips."""
    return axis.groupBy("file").agg(F.sum(F.size(clip_starts(F.col("n"), s))).cast("bigint").alias("n_clips"))


def cut_clips(waves: DataFrame, s: ClipSettings, keys: list[str], offset_s: float = 0.0) -> DataFrame:
    """Samples of every clip of array column ``samples``: (keys, clip_idx, clip_start, clip).

    Starts are shifted by a file offset. Null or short arrays give no clips.
    """
    n = F.size("samples").cast("bigint")
    shift = int(round(offset_s * s.fs))
    rows = waves.filter(n >= s.length).select(*keys, "samples", F.posexplode(clip_starts(n, s)).alias("clip_idx", "at"))
    return rows.select(*keys, "clip_idx", (F.col("at") + shift).alias("clip_start"), F.slice("samples", (F.col("at") + 1).cast("int"), F.lit(s.length)).alias("clip"))


def cut_blocks(blocks: DataFrame, s: ClipSettings, keys: list[str]) -> DataFrame:
    """Clips of recordings that come in blocks: (keys, clip_idx, clip_start, clip).

    A row holds ``samples`` from ``start_sample`` on, of a recording of ``n_samples``, and owns the clips
    that start in [own_first, own_first + own_count). Blocks carry as much context as a clip needs, so
    nothing is joined; indices and starts are those of the whole recording, the trailing clip included.
    """
    length, advance = s.length, s.advance
    size, start, n = F.size("samples").cast("bigint"), F.col("start_sample"), F.col("n_samples")
    n_clips = F.when(n >= length, F.floor((n - length) / F.lit(advance)) + 1).otherwise(0).cast("bigint")
    lo = F.ceil(F.col("own_first") / F.lit(advance))
    hi = F.least(n_clips - 1, F.ceil((F.col("own_first") + F.col("own_count")) / F.lit(advance)) - 1)
    place = lambda idx, at: F.struct(idx.cast("int").alias("clip_idx"), at.cast("bigint").alias("clip_start"))
    none = F.array().cast("array<struct<clip_idx:int,clip_start:bigint>>")
    clips = F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda i: place(i, i * advance))).otherwise(none)
    if s.trailing:
        own = has_trailing(n, s) & (n - length >= F.col("own_first")) & (n - length < F.col("own_first") + F.col("own_count"))
        clips = F.concat(clips, F.when(own, F.array(place(n_clips, n - length))).otherwise(none))
    rows = blocks.filter(size > 0).select(*keys, "samples", "start_sample", F.explode(clips).alias("c"))
    inside = rows.filter((F.col("c.clip_start") >= start) & (F.col("c.clip_start") + length <= start + size))
    return inside.select(*keys, "c.clip_idx", "c.clip_start", F.slice("samples", (F.col("c.clip_start") - start + 1).cast("int"), F.lit(length)).alias("clip"))


def salvage_clips(unmatched: DataFrame, axis: DataFrame, s: ClipSettings) -> DataFrame:
    """Clips for annotations that no regular clip covers.

    An annotation shorter than a clip gets one centred on it; a longer one is cut into clips over
    its own extent. Clips that leave the recording are dropped.
    """
    length = F.col("a1") - F.col("a0") + 1
    centred = F.array(F.col("a0") + F.floor(length / 2) - s.length // 2)
    over = F.transform(clip_starts(length, ClipSettings(s.fs, s.clip_length_s, s.clip_advance_s, False)), lambda x: x + F.col("a0"))
    rows = unmatched.join(axis, ["file", "channel"])
    rows = rows.select("annot_id", "file", "channel", "n", F.explode(F.when(length < s.length, centred).otherwise(over)).alias("clip_start"))
    return rows.filter((F.col("clip_start") >= 0) & (F.col("clip_start") + s.length <= F.col("n"))).select("annot_id", "file", "channel", "clip_start")
