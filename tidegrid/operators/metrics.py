"""Precision and recall of clip scores and of detections.

Clip level needs no product of thresholds and scores: every clip is counted at the highest
threshold it passes, and counts are then added up from the top, on a table of one row per class and
threshold. Ratios with a zero denominator are null; classes without ground truth have no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.operators import streaks
from tidegrid.operators.matching import covered_parts, covers, match_detections

#: Thresholds 0, 0.05, ... 1.
THRESHOLDS = tuple(round(0.05 * k, 2) for k in range(21))


def _threshold_rank(score, thresholds):
    """How many thresholds a score passes."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: score >= t))


def clip_counts(scored: DataFrame, thresholds=THRESHOLDS, min_fraction: float = 1.0, max_nonmatch: float = 0.0) -> DataFrame:
    """(threshold, class_idx, tp, tp_plus_fp, recall_num, recall_den) of rows (class_idx, score, cov).

    Clips with coverage between both limits count for nothing; null scores pass no threshold.
    """
    hit = F.col("cov") >= min_fraction
    judged = hit | (F.col("cov") <= max_nonmatch)
    passed = F.when(F.col("score").isNotNull() & ~F.isnan("score"), _threshold_rank(F.col("score"), thresholds)).otherwise(0)
    by_rank = scored.select("class_idx", passed.alias("passed"), hit.cast("bigint").alias("hit"), judged.cast("bigint").alias("judged")).groupBy("class_idx", "passed").agg(F.sum("hit").alias("hit"), F.sum("judged").alias("judged"))
    dim = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.lit(t).alias("threshold")) for i, t in enumerate(thresholds)]))
    per_class = by_rank.groupBy("class_idx").agg(F.sum("hit").alias("recall_den"), F.collect_list(F.struct("passed", "hit", "judged")).alias("ranks"))  # at most one entry per threshold
    at = per_class.select("class_idx", "recall_den", "ranks", dim.alias("t"))
    total = lambda name: F.aggregate(F.filter("ranks", lambda r: r["passed"] >= F.col("t.rank")), F.lit(0).cast("bigint"), lambda a, r: a + r[name])
    return at.select(F.col("t.threshold").alias("threshold"), "class_idx", total("hit").alias("tp"), total("judged").alias("tp_plus_fp"), total("hit").alias("recall_num"), "recall_den")


def ratios(counts: DataFrame) -> DataFrame:
    """Precision and recall of every class with ground truth."""
    return counts.filter("recall_den > 0").select("threshold", "class_idx", F.try_divide("tp", "tp_plus_fp").alias("precision"), F.try_divide("recall_num", "recall_den").alias("recall"))


def overall(counts: DataFrame) -> DataFrame:
    """Precision and recall over all classes together (sums of counts)."""
    s = counts.groupBy("threshold").agg(*[F.sum(c).alias(c) for c in ("tp", "tp_plus_fp", "recall_num", "recall_den")])
    return s.select("threshold", F.try_divide("tp", "tp_plus_fp").alias("precision"), F.try_divide("recall_num", "recall_den").alias("recall"))


def f1_score(precision, recall):
    return F.try_divide(2 * precision * recall, precision + recall)


def interval_counts(truth: DataFrame, found: DataFrame, min_gt: float = 0.5, min_det: float = 0.5) -> DataFrame:
    """(class_idx, tp, tp_plus_fp, recall_num, recall_den) of (file, channel, class_idx, id, b, e) rows."""
    t, d = match_detections(truth, found, ["file", "channel", "class_idx"], min_gt, min_det)
    a = t.groupBy("class_idx").agg(F.sum(F.col("recalled").cast("bigint")).alias("recall_num"), F.count("*").alias("recall_den"))
    b = d.groupBy("class_idx").agg(F.sum(F.col("true_positive").cast("bigint")).alias("tp"), F.count("*").alias("tp_plus_fp"))
    zero = F.lit(0).cast("bigint")
    return a.join(b, "class_idx", "full").select("class_idx", *[F.coalesce(c, zero).alias(c) for c in ("tp", "tp_plus_fp", "recall_num", "recall_den")])


def processed_counts(scores: DataFrame, truth: DataFrame, fs: int, length: int, thresholds=THRESHOLDS, nonmax: bool = False, squeeze: tuple[int, int] | None = None, min_gt: float = 0.5, min_det: float = 0.5) -> DataFrame:
    """Interval counts of post-processed scores at each threshold, in one pass.

    Each live score is a row at every threshold it passes, and the threshold is part of its series; the
    truth is not multiplied: what the detections of each threshold cover of it is added up.
    """
    keys, series = ["file", "channel", "class_idx"], [*streaks.SERIES, "threshold"]
    live = streaks.live_scores(scores)
    live = streaks.top_class(live) if nonmax else live
    live = live.withColumn("threshold", F.explode(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("score") >= t)))
    found = streaks.combine_streaks(live, length, series) if squeeze is None else streaks.squeeze_streaks(live, length, *squeeze, series)
    found = found.select(*series, F.xxhash64(*series, "start_samp").alias("id"), (F.col("start_samp") / fs).alias("b"), (F.col("end_samp") / fs).alias("e"))
    real = truth.select(*keys, "id", "b", "e").dropna().filter("e >= b")
    den = real.groupBy("class_idx").agg(F.count("*").alias("recall_den"), F.count(F.when(F.col("e") == F.col("b"), 1)).alias("points"))
    part = covered_parts(real, found, keys, by=("threshold",)).join(real.filter("e > b").select("id", "class_idx", "b", "e"), "id")
    recalled = part.filter(covers(F.col("covered"), min_gt)).groupBy("class_idx", "threshold").agg(F.count("*").alias("recalled"))
    hit = found.join(covered_parts(found, real, keys), "id", "left").withColumn("ok", covers(F.coalesce("covered", F.lit(0.0)), min_det))
    hit = hit.groupBy("class_idx", "threshold").agg(F.count(F.when(F.col("ok"), 1)).alias("tp"), F.count("*").alias("tp_plus_fp"))
    everywhere = den.select("class_idx", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"), "recall_den", "points")
    out = everywhere.join(recalled, ["class_idx", "threshold"], "left").join(hit, ["class_idx", "threshold"], "full")
    n = lambda *c: sum((F.coalesce(x, F.lit(0).cast("bigint")) for x in c), F.lit(0).cast("bigint"))
    return out.select("threshold", "class_idx", n("tp").alias("tp"), n("tp_plus_fp").alias("tp_plus_fp"), n("recalled", "points").alias("recall_num"), n("recall_den").alias("recall_den"))
