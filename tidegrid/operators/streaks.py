"""Clip scores to detections: threshold, non-max suppression, streaks, squeezing.

Scores are long rows (file, channel, clip_idx, clip_start, class_idx, score); a null score is
suppressed. Streaks are runs of consecutive clip indices with a live score per (file, channel,
class). Deliveries of one ``score_id`` are one; NaN scores count as null; ties go to the first
class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SERIES = ["file", "channel", "class_idx"]


def live_scores(scores: DataFrame, threshold: float | None = None) -> DataFrame:
    """Rows with a score at or above the threshold (all with a score, if None), each delivery once."""
    own = scores.select("score_id", "file", "channel", "clip_idx", "clip_start", "class_idx", "score").filter(F.col("score").isNotNull() & ~F.isnan("score"))
    if threshold is not None:
        own = own.filter(F.col("score") >= threshold)
    # one row per place, the highest score if a place was scored twice
    return own.groupBy("file", "channel", "clip_idx", "clip_start", "class_idx").agg(F.max("score").alias("score"))


def top_class(live: DataFrame) -> DataFrame:
    """Only the highest score of each clip; the first class wins ties."""
    best = live.groupBy("file", "channel", "clip_idx").agg(F.min(F.struct((-F.col("score")).alias("s"), "class_idx", "clip_start")).alias("b"))
    return best.select("file", "channel", "clip_idx", "b.clip_start", "b.class_idx", (-F.col("b.s")).alias("score"))


def _islands(live: DataFrame, series: list[str]) -> DataFrame:
    return live.withColumn("island", F.col("clip_idx") - F.row_number().over(W.partitionBy(*series).orderBy("clip_idx")))


def combine_streaks(live: DataFrame, length: int, series: list[str] = SERIES) -> DataFrame:
    """(series, start_samp, end_samp, score) of maximal streaks; ends are inclusive."""
    out = _islands(live, series).groupBy(*series, "island").agg(F.min("clip_start").alias("start_samp"), (F.max("clip_start") + (length - 1)).alias("end_samp"), F.max("score").alias("score"))
    return out.drop("island")


def squeeze_streaks(live: DataFrame, length: int, advance: int, min_length: int, series: list[str] = SERIES) -> DataFrame:
    """Detections narrowed to what groups of overlapping clips share.

    In a streak every ``g`` consecutive clips give the group [start of the last, end of the first]
    with their highest score; ``g`` is the number of clips of the grid that start within
    ``length - min_length`` of the first, or the streak's length if that is less. Groups that touch
    are merged, with the median of their scores.
    """
    group = 1 + (length - min_length) // advance
    rows = _islands(live, series)
    streak = W.partitionBy(*series, "island")
    ordered = streak.orderBy("clip_idx")
    ahead = ordered.rowsBetween(0, group - 1)
    rows = rows.withColumns({"n": F.count("*").over(streak), "rn": F.row_number().over(ordered), "top": F.max("score").over(ahead), "far": F.max("clip_start").over(ahead)})
    g = F.least(F.lit(group), F.col("n"))
    groups = rows.filter(F.col("rn") <= F.col("n") - g + 1).select(*series, "island", "rn", F.col("far").alias("gs"), (F.col("clip_start") + (length - 1)).alias("ge"), "top")
    groups = groups.withColumn("new", F.when(F.lag("ge").over(W.partitionBy(*series, "island").orderBy("rn")) + 1 >= F.col("gs"), 0).otherwise(1))
    groups = groups.withColumn("part", F.sum("new").over(W.partitionBy(*series, "island").orderBy("rn").rowsBetween(W.unboundedPreceding, 0)))
    return groups.groupBy(*series, "island", "part").agg(F.min("gs").alias("start_samp"), F.max("ge").alias("end_samp"), F.median("top").alias("score")).drop("island", "part")


def detections(scores: DataFrame, length: int, threshold: float | None = None, nonmax: bool = False, squeeze: tuple[int, int] | None = None) -> DataFrame:
    """Scores to detections; ``squeeze`` is (advance, shortest detection) in samples."""
    live = live_scores(scores, threshold)
    live = top_class(live) if nonmax else live
    return combine_streaks(live, length) if squeeze is None else squeeze_streaks(live, length, *squeeze)


def in_time_order(found: DataFrame, fs: int) -> DataFrame:
    """Detections of a file across channels, numbered by start, with times in seconds."""
    number = F.row_number().over(W.partitionBy("file").orderBy("start_samp", "channel", "class_idx", "end_samp"))
    return found.select("file", number.alias("selection"), "channel", "class_idx", (F.col("start_samp") / fs).alias("begin_s"), (F.col("end_samp") / fs).alias("end_s"), "score")


def combined_numbering(durations: DataFrame, found: DataFrame, group: str) -> DataFrame:
    """Per group of files: running offset of time and of selection numbers before each file.

    ``durations`` is (group, file, duration_s), ``found`` has one row per detection with its file.
    """
    counts = found.groupBy("file").agg(F.count("*").alias("n"))
    rows = durations.join(counts, "file", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    before = W.partitionBy(group).orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    return rows.select(group, "file", F.coalesce(F.sum("duration_s").over(before), F.lit(0.0)).alias("time_offset_s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("selection_offset"), "n")


def scaled_score(score, n_classes: int):
    """Score of one class among ``n_classes`` stretched so that chance level is 0."""
    if n_classes < 2:
        raise ValueError("scaling needs at least two classes")
    return F.greatest(F.lit(0.0), (score - 1 / n_classes) / (1 - 1 / n_classes))
