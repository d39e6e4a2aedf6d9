import json

import numpy as np
import pytest

from tidegrid.sources import annotations as A
from tidegrid.sources import assets, audio, listing, writers

ROWS = [(1.0, 1.0, 6928.456055, 6928.456055), (2.0, 2.5, None, 6334.588867), (2.5, 2.75, None, None), (3.0, 3.5, 8908.015625, None), (4.0, 4.5, 1484.669312, 2969.338523)]


def table(multi=False, aliases=False):
    low, high = ("Low Frequency (Hz)", "High Frequency (Hz)") if aliases else ("Low Freq (Hz)", "High Freq (Hz)")
    head = ["Selection", "Begin Time (s)", "End Time (s)", low, high, "Tags", "Notes"] + (["File Offset (s)", "Begin File"] if multi else ["Channel"])
    lines = ["\t".join(head)]
    for i, (b, e, lo, hi) in enumerate(ROWS):
        base = 100.0 if multi else 0.0
        tail = [str(b), "abcde"[i] + ".wav"] if multi else ["" if i == 0 else "1"]
        lines.append("\t".join([str(i + 1), str(b + base), str(e + base), "" if lo is None else str(lo), "" if hi is None else str(hi), f"t{i}", "?" if i == 2 else "", *tail]))
    return "\n".join(lines) + "\n"


def times(rows):
    return [(r["begin_s"], r["end_s"], r["low_hz"], r["high_hz"]) for r in rows]


def test_selection_tables():
    got = list(A.selection_rows(table()))
    assert times(got) == ROWS and [r["channel"] for r in got] == [0] * 5 and got[1]["label"] == "t1"
    assert times(A.selection_rows(table(aliases=True))) == ROWS
    multi = list(A.selection_rows(table(multi=True), multi_file=True))
    assert times(multi) == ROWS and [r["source_file"] for r in multi] == [c + ".wav" for c in "abcde"]
    assert len(list(A.selection_rows(table(), keep=lambda r: r["Notes"] != "?"))) == 4
    assert list(A.selection_rows("")) == []


def test_field_rules():
    head, row = ["a", "b"], ["", "x"]
    assert A.convert(head, row, "a", float, 3.0) == 3.0
    with pytest.raises(ValueError):
        A.convert(head, row, "a", float)
    assert A.convert(head, row, "b") == "x" and A.convert(head, row, "c", float, 1.0) == 1.0
    with pytest.raises(LookupError):
        A.convert(head, row, "c", float)


def test_label_tracks_and_layers():
    text = "".join(f"{b:.6f}\t{e:.6f}\tt{i}\n" + ("" if lo is None and hi is None else f"\\\t{-1 if lo is None else lo}\t{-1 if hi is None else hi}\n") for i, (b, e, lo, hi) in enumerate(ROWS))
    assert times(A.track_rows(text)) == ROWS
    xml = '<sv><data><model id="1" sampleRate="100"/><dataset><point frame="250" duration="50" value="10" extent="5" label="x"/><point frame="300" duration="10" label="y"/></dataset></data></sv>'
    assert times(A.layer_rows(xml)) == [(2.5, 3.0, 10.0, 15.0), (3.0, 3.1, None, None)]


def test_readers_report_bad_files(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "good.txt").write_text(table())
    (tmp_path / "bad.txt").write_text("Begin Time (s)\tEnd Time (s)\nx\ty\n")
    (tmp_path / "empty.txt").write_text("")
    df = A.read_selection_tables(spark, str(tmp_path)).cache()
    assert A.good_rows(df).count() == 5 and {r.annot_path for r in A.good_rows(df).collect()} == {"a b/good.txt"}
    assert [r.annot_path for r in A.bad_files(df).collect()] == ["bad.txt"]


def test_listing_pairs_and_leftovers(spark, tmp_path, rows):
    for p in ("x/1.wav", "x/2.WAV", "y/3.wav", "y/z.doc"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    files = listing.list_files(spark, str(tmp_path))
    assert rows(files, "path") == [("x/1.wav",), ("x/2.WAV",), ("y/3.wav",)]
    assert rows(listing.files_of_classes(files, ["y"]), "path", "label") == [("y/3.wav", "y")]
    (tmp_path / "map.csv").write_text("x/1.wav,a.txt,more\ny,b.txt,\nq.wav,a.txt,\nx/2.WAV,none.txt,\n")
    pairs = listing.read_selmap(spark, str(tmp_path / "map.csv"))
    annots = spark.createDataFrame([("a.txt",), ("b.txt",)], "path string")
    assert rows(listing.valid_pairs(pairs, files, annots)) == [("x/1.wav", "a.txt"), ("y", "b.txt")]
    assert rows(listing.broken_pairs(pairs, files, annots), "audio_path") == [("q.wav",), ("x/2.WAV",)]
    ann = spark.createDataFrame([("a.txt", None, 1.0), ("b.txt", "3.wav", 2.0), ("b.txt", "4.wav", 3.0)], "annot_path string, source_file string, begin_s double")
    found, missing = listing.annotated_files(listing.valid_pairs(pairs, files, annots), ann, files)
    assert rows(found, "file", "begin_s") == [("x/1.wav", 1.0), ("y/3.wav", 2.0)]
    assert rows(missing, "file") == [("y/4.wav",)]
    (tmp_path / "only.txt").write_text("a\n\n b \n")
    assert rows(listing.whitelisted(spark.createDataFrame([("a",), ("b",), ("c",)], "label string"), spark, str(tmp_path / "only.txt"))) == [("a",), ("b",)]


def test_audio_round_trip_gates_and_channels(spark, tmp_path):
    x = np.stack([np.sin(np.arange(1000) / 9), np.linspace(-1, 0.99, 1000)])
    audio.write_wav(str(tmp_path / "a.wav"), x, 100)
    audio.write_wav(str(tmp_path / "short.wav"), x[:1, :50], 100)
    (tmp_path / "c.flac").write_bytes(b"fLaC")
    info = {r.file: r for r in audio.audio_info(spark, str(tmp_path)).collect()}
    assert (info["a.wav"].fs, info["a.wav"].n_channels, info["a.wav"].n_samples, info["a.wav"].duration_s) == (100, 2, 1000, 10.0)
    assert info["c.flac"].status is not None
    got = audio.load_audio(spark, str(tmp_path), "*.wav", min_s=1.0).orderBy("channel").collect()
    assert len(got) == 2 and np.allclose(got[1].samples, x[1], atol=1 / 32768)
    part = audio.load_audio(spark, str(tmp_path), "a.wav", channels=[1, 5], offset_s=2, duration_s=3).orderBy("channel").collect()
    assert np.allclose(part[0].samples, x[1, 200:500], atol=1 / 32768) and part[1].status == "no such channel"
    blocks = audio.load_audio(spark, str(tmp_path), "a.wav", channels=[0], block_s=4).orderBy("start_sample").collect()
    assert [(b.start_sample, len(b.samples)) for b in blocks] == [(0, 400), (400, 400), (800, 200)]


def test_writers_round_trip(spark, tmp_path):
    found = spark.createDataFrame([("d/a.wav", "d/a", 1, "y", 2.0, 3.0, 10.0, 20.0, 0.5), ("d/a.wav", "d/a", 0, "x", 1.0, 1.5, 10.0, 20.0, 0.25), ("b.wav", "b", 0, None, 1.0, 1.5, None, 20.0, 0.75)], "file string, out_file string, channel int, label string, begin_s double, end_s double, low_hz double, high_hz double, score double")
    header, lines = writers.selection_lines(writers.numbered(found), frequencies=True, score=True)
    done = {r.out_file: r.n_lines for r in writers.write_lines(lines, str(tmp_path), header).collect()}
    assert done == {"d/a": 2, "b": 1}
    text = (tmp_path / "d" / "a.selections.txt").read_text().splitlines()
    assert text[0].split("\t") == ["Selection", "Channel", "Begin Time (s)", "End Time (s)", "Low Freq (Hz)", "High Freq (Hz)", "Tags", "Score"]
    assert text[1].split("\t") == ["1", "1", "1.000000", "1.500000", "10.00", "20.00", "x", "0.25"]
    back = list(A.selection_rows((tmp_path / "d" / "a.selections.txt").read_text()))
    assert [(r["begin_s"], r["channel"], r["label"]) for r in back] == [(1.0, 0, "x"), (2.0, 1, "y")]
    durations = spark.createDataFrame([("d/a.wav", 10.0), ("d/b.wav", 5.0)], "file string, duration_s double")
    two = spark.createDataFrame([("d/a.wav", 0, "x", 1.0, 2.0), ("d/b.wav", 0, "x", 0.5, 1.0)], "file string, channel int, label string, begin_s double, end_s double")
    got = writers.combined(two, durations).orderBy("selection").collect()
    assert [(r.out_file, r.selection, r.begin_s, r.file_offset_s) for r in got] == [("d", 1, 1.0, 1.0), ("d", 2, 10.5, 0.5)]
    writers.write_lines(writers.track_lines(writers.numbered(found), frequencies=True), str(tmp_path / "t"), suffix=".txt").collect()
    assert times(A.track_rows((tmp_path / "t" / "b.txt").read_text())) == [(1.0, 1.5, None, 20.0)]


def test_parquet_sinks(spark, tmp_path):
    df = spark.createDataFrame([("f", 0, 16, [1, 2], [0.0, 1.0])], "file string, channel int, clip_start long, clip array<smallint>, labels array<float>")
    writers.write_prepared(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).collect() == df.collect()
    sc = spark.createDataFrame([("f", 0, 1, 16, 0, None)], "file string, channel int, clip_idx int, clip_start long, class_idx int, score double")
    writers.write_scores(sc, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).collect() == sc.collect()


def test_assets(tmp_path):
    assets.write_json(str(tmp_path), assets.CLASSES, ["a"])
    assert json.loads((tmp_path / assets.CLASSES).read_text()) == ["a"] == assets.read_json(str(tmp_path), assets.CLASSES)
    (tmp_path / "c.ini").write_text("[DATA]\nfs = 100\nband = (1, 2)\nname = plain\n")
    template = {"DATA": {"fs": (int, ...), "band": (tuple, None), "name": (str, ""), "more": (float, 0.5)}}
    assert assets.read_settings(str(tmp_path / "c.ini"), template) == {"DATA": {"fs": 100, "band": (1, 2), "name": "plain", "more": 0.5}}
    with pytest.raises(ValueError):
        assets.read_settings(str(tmp_path / "c.ini"), {"DATA": {"fs": (int, ...)}})


def test_registered_source(spark, tmp_path):
    from tidegrid.sources.datasource import AnnotationSource

    (tmp_path / "good.txt").write_text(table())
    (tmp_path / "bad.txt").write_text("x\ny\n")
    spark.dataSource.register(AnnotationSource)
    df = spark.read.format("annotations").option("kind", "selections").load(str(tmp_path))
    rows = df.orderBy("annot_path", "row_no").collect()
    assert [r.annot_path for r in rows] == ["bad.txt"] + ["good.txt"] * 5 and rows[0].status is not None
    assert times(r.asDict() for r in rows[1:]) == ROWS
