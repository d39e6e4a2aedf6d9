"""The four verbs as logical plans: prepare, feed and train, recognize, assess."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import signal, spectral
from tidegrid.operators import coverage, labels, metrics, sampling, segment, streaks
from tidegrid.operators.segment import ClipSettings
from tidegrid.plans import models
from tidegrid.store import durable


BLOCK_COLUMNS = ["start_sample", "own_first", "own_count", "n_samples"]


def prepared_waves(waves: DataFrame, s: ClipSettings) -> DataFrame:
    """Waveforms (file, channel, fs, samples) at the settings' rate, filtered as wholes.

    Rows without a rate lose their samples. The places of blocks (``BLOCK_COLUMNS``), where there are
    any, are brought to the new rate too; blocks begin at whole seconds.
    """
    x = signal.resampler(s.fs)(F.col("fs"), F.transform("samples", lambda v: v.cast("double")))
    if s.filterspec is not None:
        order, edges, kind = s.filterspec
        x = signal.zero_phase_filter(order, edges, kind, s.fs)(x)
    out = waves.withColumn("samples", x)
    if set(BLOCK_COLUMNS) <= set(waves.columns):
        scaled = lambda c: F.ceil(c * s.fs / F.col("fs")).cast("bigint")
        first = scaled(F.col("own_first"))
        until = scaled(F.col("own_first") + F.col("own_count"))
        out = out.withColumns({"start_sample": scaled(F.col("start_sample")), "own_first": first, "own_count": until - first, "n_samples": scaled(F.col("n_samples"))})
    return out.withColumn("fs", F.when(F.col("fs").isNotNull(), F.lit(s.fs)))


def _cut(ready: DataFrame, s: ClipSettings) -> DataFrame:
    blocks = set(BLOCK_COLUMNS) <= set(ready.columns)
    clips = (segment.cut_blocks if blocks else segment.cut_clips)(ready, s, ["file", "channel"])
    return clips.withColumn("clip", signal.normalizer()(F.col("clip"))) if s.normalize else clips


def channel_clips(waves: DataFrame, s: ClipSettings) -> DataFrame:
    """(file, channel, clip_idx, clip_start, clip) of waveforms (file, channel, fs, samples), or of blocks.

    Channels are brought to the settings' rate and filtered as wholes before they are cut; blocks as
    they are, so their context must also hold what the filter needs to settle.
    """
    return _cut(prepared_waves(waves, s), s)


def _near_salvaged(extra: DataFrame, own: DataFrame, axis: DataFrame, s: ClipSettings) -> DataFrame:
    """Salvage clips with every annotation that overlaps them, met in buckets of a clip's length."""
    length = F.lit(s.length).cast("bigint")
    reach = own.drop("annot_id").join(axis, ["file", "channel"]).filter("a0 < n and a1 >= 0")
    buckets = F.sequence(F.floor(F.greatest("a0", F.lit(0)) / length), F.floor(F.least("a1", F.col("n") - 1) / length))
    reach = reach.withColumn("bucket", F.explode(buckets)).drop("n")
    first = F.floor(F.col("clip_start") / length)
    clips = extra.drop("annot_id").distinct().withColumn("bucket", F.explode(F.array(first, first + 1)))
    met = clips.join(reach, ["file", "channel", "bucket"]).drop("bucket")
    return met.withColumn("overlap", F.least("a1", F.col("clip_start") + (s.length - 1)) - F.greatest("a0", "clip_start") + 1).filter("overlap > 0")


def prepare(waves: DataFrame, annotations: DataFrame, classes: DataFrame, s: ClipSettings, remap: DataFrame | None = None, min_fraction: float = 1.0, centralized: bool = False, max_nonmatch: float | None = None, salvage: bool = False) -> tuple[DataFrame, DataFrame]:
    """Prepared clips (file, channel, clip_start, clip, labels) and clip counts per class.

    ``annotations`` has (annot_id, file, channel, label, begin_s, end_s). With ``max_nonmatch``
    (below ``min_fraction``) clips that overlap nothing become clips of the negative class; with
    ``salvage`` unmatched annotations get clips of their own, cut from the same resampled and filtered
    channel as the others (whole channels only, not blocks). Only recordings that can yield a clip
    are decoded when ``waves`` is a lazy scan: without negatives, the others are pruned by a join.
    """
    if max_nonmatch is not None and not max_nonmatch < min_fraction:
        raise ValueError("max_nonmatch must be below min_fraction")
    blocks = set(BLOCK_COLUMNS) <= set(waves.columns)
    if salvage and blocks:
        raise ValueError("salvage clips are cut from whole channels")
    n_classes = classes.agg(F.max("class_idx") + 1).first()[0]
    own = labels.map_labels(coverage.sample_annotations(annotations, s.fs), classes, remap)
    if max_nonmatch is None:
        waves = waves.join(own.select("file").distinct(), "file", "left_semi")
    size = F.col("n_samples") if blocks else F.size("samples")
    axis = waves.select("file", "channel", F.ceil(size * F.lit(s.fs) / F.col("fs")).cast("bigint").alias("n")).filter("n > 0").groupBy("file", "channel").agg(F.max("n").alias("n"))
    ready = prepared_waves(waves, s)
    if salvage:
        ready = durable(ready.select("file", "channel", "fs", "samples"), "waves")
    place = ("file", "channel", "clip_start")
    touched = coverage.touched_clips(own, axis, s)
    covered = coverage.clip_coverage(touched, s, centralized)
    values = coverage.prepared_labels(coverage.coverage_by_class(covered, (*place, "class_idx")), min_fraction, "clip_start")
    if salvage:
        extra = segment.salvage_clips(coverage.unmatched(own, covered, min_fraction), axis, s)
        by_class = coverage.coverage_by_class(coverage.clip_coverage(_near_salvaged(extra, own, axis, s), s, centralized), (*place, "class_idx"))
        by_class = by_class.withColumn("label_value", coverage.adjusted(F.col("cov"), min_fraction)).drop("cov")
        top = by_class.groupBy(*place).agg(F.max("label_value").alias("m")).filter("m = 1.0").drop("m")
        values = values.unionByName(by_class.join(top, [*place], "left_semi")).distinct()
    if max_nonmatch is not None:
        negative = classes.filter("is_negative").select("class_idx").first()[0]
        values = values.filter(F.col("class_idx") != negative)
        free = coverage.negative_clips(segment.clip_grid(axis, s), touched, s, max_nonmatch)
        values = values.unionByName(free.select(*place, F.lit(negative).cast("int").alias("class_idx"), F.lit(1.0).alias("label_value")))
    counts = values.filter("label_value = 1.0").groupBy("class_idx").agg(F.count("*").alias("n_clips"))
    per_clip = values.groupBy(*place).agg(F.map_from_entries(F.collect_set(F.struct("class_idx", "label_value"))).alias("m"))
    hot = F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("float"))
    per_clip = per_clip.select(*place, hot.alias("labels"))
    out = per_clip.join(_cut(ready, s).drop("clip_idx"), [*place])
    if salvage:
        # clips off the grid: each channel meets the list of its starts once
        grid = segment.clip_grid(axis, s).select(*place)
        off = per_clip.join(grid, [*place], "left_anti")
        starts = off.groupBy("file", "channel").agg(F.collect_list("clip_start").alias("starts"))  # at most one for each sample of a channel
        cut = ready.join(starts, ["file", "channel"]).select("file", "channel", "samples", F.explode("starts").alias("clip_start"))
        cut = cut.select(*place, F.slice("samples", (F.col("clip_start") + 1).cast("int"), F.lit(s.length)).alias("clip"))
        if s.normalize:
            cut = cut.withColumn("clip", signal.normalizer()(F.col("clip")))
        out = out.unionByName(off.join(cut, [*place]))
    return out.withColumn("clip", signal.float_to_pcm(F.col("clip"))), counts


class Feeder:
    """Batches for training, with three hooks that subclasses replace.

    ``pre`` works on the stored clips, ``transform`` makes features, ``post`` works on features;
    augmentations belong into the hooks. Picks follow ``sampling.pick_per_class``.
    """

    def __init__(self, prepared: DataFrame, seed: int = 42, min_per_class: int = 0, cap: int | None = None, validation: float = 0.0, background: int | None = None, single: bool = False):
        self.seed, self.background = seed, background
        labelled = F.posexplode(sampling.one_hot(F.col("labels")) if single else F.col("labels")).alias("class_idx", "value")
        rows = prepared.select("clip_id", labelled).filter("value >= 0.5").select("clip_id", "class_idx")
        if min_per_class:
            rows = sampling.classes_with(rows, "class_idx", min_per_class)
        picked = sampling.pick_per_class(rows, "class_idx", "clip_id", seed, cap, validation)
        self.parts = sampling.disjoint_parts(picked, "clip_id").select("clip_id", "part").distinct()
        self.prepared = prepared

    def pre(self, clip: Column) -> Column:
        return clip

    def transform(self, clip: Column) -> Column:
        return clip

    def post(self, features: Column) -> Column:
        return features

    def rows(self, training: bool = True) -> DataFrame:
        """(clip_id, features, labels) of the training or validation part."""
        part = self.parts.filter(F.col("part") == ("train" if training else "validation")).select("clip_id")
        labels_ = F.col("labels")
        if self.background is not None:
            labels_ = F.filter(labels_, lambda v, i: i != self.background)
        clip = signal.pcm_to_float(F.col("clip"))
        return self.prepared.join(part, "clip_id", "left_semi").select("clip_id", self.post(self.transform(self.pre(clip))).alias("features"), labels_.alias("labels"))

    def batches(self, size: int, training: bool = True):
        """Iterator of pandas frames of ``size`` rows, in shuffled order for training."""
        rows = self.rows(training)
        rows = rows.orderBy(sampling.shuffled("clip_id", self.seed)) if training else rows.orderBy("clip_id")
        held: list = []
        import pandas as pd

        for row in rows.toLocalIterator(prefetchPartitions=True):
            held.append(row.asDict())
            if len(held) == size:
                yield pd.DataFrame(held)
                held = []
        if held:
            yield pd.DataFrame(held)


class SpectralFeeder(Feeder):
    """Feeder whose features are flattened spectrograms of (optionally normalised) clips."""

    def __init__(self, prepared: DataFrame, settings: spectral.SpectralSettings, normalize: bool = True, **options):
        super().__init__(prepared, **options)
        self.settings, self.normalize = settings, normalize

    def transform(self, clip: Column) -> Column:
        return F.flatten(spectral.spectrogram(self.settings, self.normalize)(clip))


def recognize(spark: SparkSession, clips: DataFrame, model, s: ClipSettings, threshold: float | None = None, scale: bool = False, reject: list[int] | None = None, nonmax: bool = False, squeeze_s: float | None = None, features: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw scores (file, channel, clip_idx, clip_start, class_idx, score) and detections.

    ``clips`` comes from ``channel_clips``. Rejected classes are dropped before post-processing. The raw
    scores are written once, so that the model runs once for both results.
    """
    x = F.col("clip") if features is None else features(F.col("clip"))
    raw = models.score_rows(clips.withColumn("scores", models.scorer(spark, model)(x)), ["file", "channel", "clip_idx", "clip_start"])
    if scale:
        raw = raw.withColumn("score", streaks.scaled_score(F.col("score"), len(model.classes)))
    raw = durable(raw, "scores")
    live = labels.reject_classes(raw, reject or []).filter("score is not null")
    if threshold is not None:
        live = live.filter(F.col("score") >= threshold)
    live = streaks.top_class(live) if nonmax else live
    found = streaks.combine_streaks(live, s.length) if squeeze_s is None else streaks.squeeze_streaks(live, s.length, s.advance, int(squeeze_s * s.fs))
    return raw, found


def detection_table(found: DataFrame, classes: DataFrame, fs: int, bounds: DataFrame | None = None, band: tuple[float, float] | None = None) -> DataFrame:
    """Detections with labels, seconds and frequency bounds (class bounds, else the band, else 0 to fs/2)."""
    from tidegrid.store import broadcast_if_small

    out = found.join(broadcast_if_small(classes.select("class_idx", "label")), "class_idx")
    low, high = band or (0.0, fs / 2)
    if bounds is not None:
        out = out.join(broadcast_if_small(bounds.select("label", F.col("low_hz").alias("__l"), F.col("high_hz").alias("__h"))), "label", "left")
    else:
        out = out.withColumns({"__l": F.lit(None).cast("double"), "__h": F.lit(None).cast("double")})
    return out.select("file", "channel", "label", (F.col("start_samp") / fs).alias("begin_s"), (F.col("end_samp") / fs).alias("end_s"), F.coalesce("__l", F.lit(float(low))).alias("low_hz"), F.coalesce("__h", F.lit(float(high))).alias("high_hz"), "score")


class Metric:
    """Extension point of assessments: rows in, aggregate out, result at the end.

    ``accumulate`` returns partial aggregates per file group (they are combined with map-side
    aggregation), ``produce`` turns the combined table into the result.
    """

    def accumulate(self, scored: DataFrame) -> DataFrame:
        raise NotImplementedError

    def produce(self, total: DataFrame) -> DataFrame:
        return total

    def assess(self, scored: DataFrame) -> DataFrame:
        return self.produce(self.accumulate(scored))


class PrecisionRecall(Metric):
    """Clip-level precision and recall of rows (class_idx, score, cov)."""

    def __init__(self, thresholds=metrics.THRESHOLDS, min_fraction: float = 1.0, max_nonmatch: float = 0.0, return_counts: bool = False):
        self.thresholds, self.min_fraction, self.max_nonmatch, self.return_counts = thresholds, min_fraction, max_nonmatch, return_counts

    def accumulate(self, scored: DataFrame) -> DataFrame:
        return metrics.clip_counts(scored, self.thresholds, self.min_fraction, self.max_nonmatch)

    def produce(self, total: DataFrame) -> DataFrame:
        return total if self.return_counts else metrics.ratios(total)
