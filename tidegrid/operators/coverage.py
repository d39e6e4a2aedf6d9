"""How far annotations cover clips, and what follows from it.

Sample intervals are closed. Coverage of a clip by an annotation is their overlap divided by the
shorter of the two, and of a class the maximum over its annotations. Regular clips make the
overlapping clip indices computable, so instead of a range join each annotation is exploded to the
clips it touches and one aggregation with map-side combining by (file, channel, clip, class)
follows; a hot file is spread over its clips.

Annotations with a null file, channel, label or time, or with their end before their beginning, are
left out; deliveries of one ``annot_id`` are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.segment import ClipSettings, has_trailing


def sample_annotations(annotations: DataFrame, fs: int) -> DataFrame:
    """(annot_id, file, channel, label, a0, a1): first and last sample, seconds rounded half-even."""
    own = annotations.select("annot_id", "file", "channel", "label", F.rint(F.col("begin_s") * fs).try_cast("bigint").alias("a0"), F.rint(F.col("end_s") * fs).try_cast("bigint").alias("a1"))
    own = own.dropna().filter("a1 >= a0")
    return own.groupBy("annot_id").agg(F.max(F.struct("file", "channel", "label", "a0", "a1")).alias("a")).select("annot_id", "a.*")


def touched_clips(annotations: DataFrame, axis: DataFrame, s: ClipSettings) -> DataFrame:
    """Annotation x clip pairs that overlap, the trailing clip included: adds clip_idx, clip_start, overlap."""
    length, advance = s.length, s.advance
    rows = annotations.join(axis, ["file", "channel"])
    n_clips = F.when(F.col("n") >= length, F.floor((F.col("n") - length) / advance) + 1).otherwise(0)
    lo = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("a0") - length + 1) / F.lit(advance)))
    hi = F.least(n_clips - 1, F.floor(F.col("a1") / F.lit(advance)))
    place = lambda idx, start: F.struct(idx.cast("int").alias("clip_idx"), start.cast("bigint").alias("clip_start"))
    none = F.array().cast("array<struct<clip_idx:int,clip_start:bigint>>")
    clips = F.when(F.col("lo") <= F.col("hi"), F.transform(F.sequence("lo", "hi"), lambda i: place(i, i * advance))).otherwise(none)
    if s.trailing:
        start = F.col("n") - length
        last = F.when(has_trailing(F.col("n"), s) & (F.col("a1") >= start) & (F.col("a0") < F.col("n")), F.array(place(F.col("n_clips"), start))).otherwise(none)
        clips = F.concat(clips, last)
    rows = rows.withColumns({"lo": lo, "hi": hi, "n_clips": n_clips}).select(*annotations.columns, F.explode(clips).alias("c")).select(*annotations.columns, "c.*")
    return rows.withColumn("overlap", F.least("a1", F.col("clip_start") + (length - 1)) - F.greatest("a0", "clip_start") + 1)


def centred_factor(s: ClipSettings) -> Column:
    """Penalty for short annotations that lie off the middle of a clip.

    Annotations under half a clip that are neither within the middle half nor across the centre keep
    ``1 - distance of their nearer edge from the centre / half a clip`` of their coverage.
    """
    length = s.length
    first, last = F.col("clip_start") + length // 4, F.col("clip_start") + (length - 1 - -(-length // 4))
    centre = F.col("clip_start") + (length - 1) / 2
    short = (F.col("a1") - F.col("a0") + 1) < length // 2
    inside = (F.col("a0") >= first) & (F.col("a1") <= last)
    across = (F.col("a0") < centre) & (F.col("a1") > centre)
    away = 1 - F.least(F.abs(centre - F.col("a0")), F.abs(centre - F.col("a1"))) / (length // 2)
    return F.when(short & ~inside & ~across, away).otherwise(F.lit(1.0))


def clip_coverage(touched: DataFrame, s: ClipSettings, centralized: bool = False) -> DataFrame:
    """Pairs with their coverage ``cov``."""
    cov = F.col("overlap") / F.least(F.lit(s.length).cast("bigint"), F.col("a1") - F.col("a0") + 1)
    return touched.withColumn("cov", cov * centred_factor(s) if centralized else cov)


def coverage_by_class(covered: DataFrame, keys: tuple[str, ...] = ("file", "channel", "clip_idx", "class_idx")) -> DataFrame:
    """Largest coverage of each clip by each class."""
    return covered.groupBy(*keys).agg(F.max("cov").alias("cov"))


def matched(covered: DataFrame, min_fraction: float) -> DataFrame:
    """Annotations that some clip covers far enough: (annot_id)."""
    return covered.filter(F.col("cov") >= min_fraction).select("annot_id").distinct()


def unmatched(annotations: DataFrame, covered: DataFrame, min_fraction: float) -> DataFrame:
    """Annotations that no clip covers far enough."""
    return annotations.join(matched(covered, min_fraction), "annot_id", "left_anti")


def negative_clips(grid: DataFrame, touched: DataFrame, s: ClipSettings, max_nonmatch: float) -> DataFrame:
    """Clips that no annotation of any class overlaps by more than ``max_nonmatch`` of a clip."""
    busy = touched.filter(F.col("overlap") / F.lit(s.length) > max_nonmatch).select("file", "channel", "clip_idx").distinct()
    return grid.join(busy, ["file", "channel", "clip_idx"], "left_anti")


def adjusted(cov: Column, min_fraction: float) -> Column:
    """Label value of a coverage: 1 from the fraction on, itself from a third of it, else 0."""
    return F.when(cov >= min_fraction, 1.0).when(cov >= min_fraction / 3, cov).otherwise(0.0)


def prepared_labels(by_class: DataFrame, min_fraction: float, clip: str = "clip_idx") -> DataFrame:
    """Label values of the clips that some class covers far enough; ``clip`` tells clips of a channel apart."""
    place = ["file", "channel", clip]
    keep = by_class.groupBy(*place).agg(F.max("cov").alias("top")).filter(F.col("top") >= min_fraction).drop("top")
    kept = by_class.join(keep, place, "left_semi")
    return kept.withColumn("label_value", adjusted(F.col("cov"), min_fraction)).drop("cov")


def prepared_counts(labels: DataFrame) -> DataFrame:
    """(class_idx, n_clips): clips whose label is 1."""
    return labels.filter("label_value = 1.0").groupBy("class_idx").agg(F.count("*").alias("n_clips"))
