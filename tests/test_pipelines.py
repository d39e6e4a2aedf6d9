import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions.spectral import SpectralSettings
from tidegrid.operators import coverage, segment
from tidegrid.operators.segment import ClipSettings
from tidegrid.plans import models, pipelines
from tidegrid.sources import writers
from tidegrid.streaming import streams

FS = 100
S = ClipSettings(FS, 1.0, 0.5)


@pytest.fixture(scope="module")
def sound(spark):
    """One minute of noise with tones of two pitches, and where they are."""
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.05, 60 * FS)
    ann = []
    for i in range(24):
        a, f, name = 2.3 * i + 1.0, (10, 30)[i % 2], ("low", "high")[i % 2]
        n = np.arange(int(1.2 * FS))
        x[int(a * FS) : int(a * FS) + len(n)] += np.sin(2 * np.pi * f * n / FS)
        ann.append((i, "f.wav", 0, name, a, a + 1.2))
    waves = spark.createDataFrame([("f.wav", 0, FS, [float(v) for v in x])], "file string, channel int, fs int, samples array<float>")
    annotations = spark.createDataFrame(ann, "annot_id long, file string, channel int, label string, begin_s double, end_s double")
    classes = spark.createDataFrame([("high", 0, False), ("low", 1, False), ("Other", 2, True)], "label string, class_idx int, is_negative boolean")
    return waves, annotations, classes


def test_prepare_train_recognize_assess(spark, sound, tmp_path):
    waves, annotations, classes = sound
    prepared, counts = pipelines.prepare(waves, annotations, classes, S, min_fraction=0.9, max_nonmatch=0.1)
    writers.write_prepared(prepared, str(tmp_path / "prepared"))
    prepared = spark.read.parquet(str(tmp_path / "prepared"))
    n = {r.class_idx: r.n_clips for r in counts.collect()}
    assert set(n) == {0, 1, 2} and n[0] >= 12 and n[1] >= 12 and prepared.count() == sum(n.values())
    rows = prepared.withColumn("clip_id", F.col("clip_start"))
    feeder = pipelines.SpectralFeeder(rows, SpectralSettings(FS, 0.16, 0.5, kind="spec_db"), validation=0.2, seed=3)
    train = feeder.rows(True).cache()
    assert train.count() + feeder.rows(False).count() == prepared.count()
    assert sum(len(b) for b in feeder.batches(7)) == train.count()
    names = ["high", "low", "Other"]
    model, history = models.train_linear(train.withColumn("y", F.array_position("labels", F.lit(1.0).cast("float")) - 1), "features", "y", names, l2=0.01)
    assert history["loss"][0][-1] < history["loss"][0][0]
    model.save(str(tmp_path / "m"), {"fs": FS})
    model = models.LinearModel.load(str(tmp_path / "m"))
    clips = pipelines.channel_clips(waves, S)
    raw, found = pipelines.recognize(spark, clips, model, S, threshold=0.5, reject=[2], nonmax=True, features=lambda c: feeder.transform(c))
    assert raw.count() == clips.count() * 3
    table = pipelines.detection_table(found, classes, FS, band=(1.0, 40.0))
    assert table.filter("label = 'low'").count() >= 8
    axis = segment.recordings_axis(waves.select("file", "channel", "fs", F.size("samples").alias("n_samples")), FS)
    own = coverage.sample_annotations(annotations, FS).join(classes, "label")
    cov = coverage.coverage_by_class(coverage.clip_coverage(coverage.touched_clips(own, axis, S), S))
    scored = raw.join(cov, ["file", "channel", "clip_idx", "class_idx"], "left").fillna(0.0, ["cov"]).filter("class_idx < 2")
    result = {(r.threshold, r.class_idx): r for r in pipelines.PrecisionRecall(min_fraction=0.9, max_nonmatch=0.1).assess(scored).collect()}
    assert result[0.5, 0].precision > 0.8 and result[0.5, 0].recall > 0.8


def test_salvage_adds_clips(sound):
    waves, annotations, classes = sound
    s = ClipSettings(FS, 2.0, 2.0)
    plain, few = pipelines.prepare(waves, annotations, classes, s, min_fraction=1.0)
    more, many = pipelines.prepare(waves, annotations, classes, s, min_fraction=1.0, salvage=True)
    assert sum(r.n_clips for r in many.collect()) > sum(r.n_clips for r in few.collect())
    assert more.count() > plain.count() and more.filter(F.size("clip") != 200).count() == 0
    with pytest.raises(ValueError):
        pipelines.prepare(waves, annotations, classes, s, min_fraction=0.5, max_nonmatch=0.5)


def test_filter_and_resample_before_clipping(sound):
    waves, _, _ = sound
    s = ClipSettings(50, 1.0, 1.0, normalize=False, filterspec=(4, 20.0, "lowpass"))
    clips = pipelines.channel_clips(waves, s).collect()
    assert len(clips) == 60 and all(len(c.clip) == 50 for c in clips)


def test_multilabel_training_and_null_features(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    rows = spark.createDataFrame([([float(v) for v in r], [float(r[0] > 0), float(r[1] > 0)]) for r in x], "f array<double>, y array<double>")
    model, _ = models.train_linear(rows, "f", "y", ["a", "b"], multilabel=True, l2=0.001)
    got = spark.createDataFrame([([3.0, -3.0, 0.0],), (None,)], "f array<double>").select(models.scorer(spark, model)("f").alias("s")).collect()
    assert got[0].s[0] > 0.9 and got[0].s[1] < 0.1 and got[1].s is None


def test_stream_of_clip_streaks(spark, tmp_path):
    import datetime as dt
    import random

    from tidegrid.plans.catalog import drain

    t0 = dt.datetime(2024, 1, 1)
    idx = [0, 1, 2, 5, 6, 9, 20, 21, 22, 23]
    rows = [("a", i, i / 100, t0 + dt.timedelta(seconds=i)) for i in idx] + [("b", 7, 0.5, t0 + dt.timedelta(seconds=7)), ("z", 10_000, 0.0, t0 + dt.timedelta(seconds=10_000))]
    random.Random(0).shuffle(rows)
    schema = "series string, clip_idx long, score double, ts timestamp"
    for k in range(0, len(rows), 4):
        spark.createDataFrame(rows[k : k + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = drain(spark, streams.index_streaks(source, 1.0, "1 hour"), "idx")
    got = sorted((r.series, r.first_idx, r.last_idx, r.score) for r in out.filter("series <> 'z'").collect())
    assert got == [("a", 0, 2, 0.02), ("a", 5, 6, 0.06), ("a", 9, 9, 0.09), ("a", 20, 23, 0.23), ("b", 7, 7, 0.5)]


def test_windows_on_tables(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "k", 1.0), ("2024-01-01 00:50:00", "k", 2.0), ("2024-01-01 02:00:00", "k", 3.0)], "t string, key string, value double").withColumn("ts", F.to_timestamp("t"))
    assert streams.tumbling_counts(df, "ts", "1 hour", ["key"]).count() == 2
    assert streams.sliding_clip_counts(df, "ts", "2 hours", "1 hour", ["key"]).agg(F.sum("n")).first()[0] == 6
    assert sorted(r.n for r in streams.live_streaks(df, "ts", "1 hour", ["key"]).collect()) == [1, 2]


def test_any_number_of_sample_rates_is_resampled(spark):
    waves = spark.range(1200).selectExpr("cast(id as string) file", "0 channel", "cast(id + 64 as int) fs", "transform(sequence(1, cast(id + 64 as int)), x -> cast(x as float)) samples")
    s = ClipSettings(fs=64, clip_length_s=1.0, clip_advance_s=1.0, normalize=False)
    got = pipelines.channel_clips(waves.union(spark.createDataFrame([("null", 0, None, [1.0] * 64)], "file string, channel int, fs int, samples array<float>")), s)
    assert got.count() == 1200


def test_trailing_clips_are_touched_and_not_negative(spark, rows):
    s = ClipSettings(fs=1, clip_length_s=20.0, clip_advance_s=15.0, trailing=True)
    axis = spark.createDataFrame([("f", 0, 48)], "file string, channel int, n bigint")
    own = spark.createDataFrame([(1, "f", 0, "x", 44, 47)], "annot_id long, file string, channel int, label string, a0 bigint, a1 bigint")
    touched = coverage.touched_clips(own, axis, s)
    assert rows(touched, "clip_idx", "clip_start", "overlap") == [(2, 28, 4)]
    assert rows(coverage.negative_clips(segment.clip_grid(axis, s), touched, s, 0.0), "clip_start") == [(0,), (15,)]


def test_salvaged_clips_are_resampled_like_the_others(spark):
    ramp = [float(i) / 1000 for i in range(400)]
    waves = spark.createDataFrame([("f", 0, 20, ramp)], "file string, channel int, fs int, samples array<float>")
    found = spark.createDataFrame([(1, "f", 0, "x", 5.5, 5.9)], "annot_id long, file string, channel int, label string, begin_s double, end_s double")
    classes = spark.createDataFrame([("x", 0, False)], "label string, class_idx int, is_negative boolean")
    s = ClipSettings(fs=10, clip_length_s=1.0, clip_advance_s=1.0, normalize=False)
    found = found.union(spark.createDataFrame([(2, "f", 0, "x", 7.75, 8.35)], found.schema))
    clips = {r.clip_start: r.clip for r in pipelines.prepare(waves, found, classes, s, salvage=True)[0].collect()}
    assert set(clips) == {50, 76}
    for start, clip in clips.items():
        assert abs(clip[0] / 32768 - start / 500) < 2e-3 and abs(clip[9] / 32768 - (start + 9) / 500) < 2e-3


def test_blocks_give_the_clips_of_the_whole(spark, tmp_path):
    from tidegrid.sources import audio

    x = np.random.default_rng(1).normal(0, 0.2, (2, 48 * 21 + 13))
    audio.write_wav(str(tmp_path / "a.wav"), x, 48)
    for normalize, trailing, fs in ((False, True, 48), (True, False, 48), (False, True, 16)):
        s = ClipSettings(fs=fs, clip_length_s=2.0, clip_advance_s=1.5, trailing=trailing, normalize=normalize)
        whole = {(r.channel, r.clip_idx, r.clip_start): r.clip for r in pipelines.channel_clips(audio.load_audio(spark, str(tmp_path)), s).collect()}
        blocks = pipelines.channel_clips(audio.load_audio(spark, str(tmp_path), block_s=4, context_s=15), s).collect()
        assert len(blocks) == len(whole) > 20
        for r in blocks:
            assert np.allclose(r.clip, whole[r.channel, r.clip_idx, r.clip_start], atol=1e-5)


def test_decoder_of_the_caller(spark, tmp_path):
    from tidegrid.sources import audio

    (tmp_path / "a.MP3").write_bytes(b"12345678")
    (tmp_path / "b.mp3").write_bytes(b"")
    decoders = {".mp3": lambda data: (4, np.frombuffer(data, np.uint8)[None] / 256) if data else 1 / 0}
    got = {r.file: r for r in audio.load_audio(spark, str(tmp_path), decoders=decoders).collect()}
    assert got["a.MP3"].fs == 4 and len(got["a.MP3"].samples) == 8
    assert "b.mp3" not in got or got["b.mp3"].status
