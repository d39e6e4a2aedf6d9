import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import coverage, labels, matching, metrics, sampling, segment, streaks
from tidegrid.operators.segment import ClipSettings

S = ClipSettings(1, 10, 4)


def starts(n, length, advance, trailing):
    own = list(range(0, n - length + 1, advance)) if n >= length else []
    if trailing and own:
        left = n - length - own[-1]
        if left > 0 and left >= min(length // 2, length - advance):
            own.append(n - length)
    return own


def test_grid_with_and_without_trailing_clip(spark, rows):
    for advance in (4, 10):
        for trailing in (False, True):
            s = ClipSettings(1, 10, advance, trailing)
            axis = spark.createDataFrame([(f"f{n}", 0, n) for n in (0, 5, 10, 11, 14, 15, 17, 23, 40)], "file string, channel int, n bigint")
            got = rows(segment.clip_grid(axis, s), "file", "clip_idx", "clip_start", "clip_end")
            want = sorted(((f"f{n}", i, x, x + 9) for n in (0, 5, 10, 11, 14, 15, 17, 23, 40) for i, x in enumerate(starts(n, 10, advance, trailing))), key=repr)
            assert got == want
            assert dict(map(tuple, segment.clip_counts(axis, s).collect()))["f40"] == len(starts(40, 10, advance, trailing))


def test_settings_are_checked():
    with pytest.raises(ValueError):
        ClipSettings(10, 1.0, 1.5)
    with pytest.raises(ValueError):
        ClipSettings(10, 1.0, 0)


def test_cut_clips_nulls_and_offset(spark, rows):
    df = spark.createDataFrame([("a", [float(i) for i in range(12)]), ("b", None), ("c", []), ("d", [1.0])], "k string, samples array<double>")
    got = rows(segment.cut_clips(df, ClipSettings(1, 4, 4), ["k"], offset_s=100))
    assert [(g[0], g[1], g[2]) for g in got] == [("a", 0, 100), ("a", 1, 104), ("a", 2, 108)] and got[1][3] == [4.0, 5.0, 6.0, 7.0]


def overlaps(annots, n):
    return [(i, k, st, min(a1, st + 9) - max(a0, st) + 1) for i, a0, a1 in annots for k, st in enumerate(starts(n, 10, 4, False)) if min(a1, st + 9) >= max(a0, st)]


def test_coverage_negatives_and_salvage_against_brute_force(spark, rows):
    rng = random.Random(3)
    annots = [(i, a := rng.randrange(0, 70), a + rng.choice([0, 1, 2, 5, 9, 14, 30])) for i in range(25)]
    df = spark.createDataFrame([(i, "f", 0, "x", a, b, i % 3) for i, a, b in annots], "annot_id long, file string, channel int, label string, a0 long, a1 long, class_idx int")
    axis = spark.createDataFrame([("f", 0, 75)], "file string, channel int, n bigint")
    touched = coverage.touched_clips(df, axis, S)
    want = overlaps(annots, 75)
    assert rows(touched, "annot_id", "clip_idx", "clip_start", "overlap") == sorted(want, key=repr)
    covered = coverage.clip_coverage(touched, S)
    length = {i: b - a + 1 for i, a, b in annots}
    best = {}
    for i, k, _, o in want:
        best[k, i % 3] = max(best.get((k, i % 3), 0), o / min(10, length[i]))
    assert {(r.clip_idx, r.class_idx): r.cov for r in coverage.coverage_by_class(covered).collect()} == pytest.approx(best)
    matched = {i for i, k, _, o in want if o / min(10, length[i]) >= 0.9}
    assert {r.annot_id for r in coverage.matched(covered, 0.9).collect()} == matched
    unmatched = {r.annot_id for r in coverage.unmatched(df, covered, 0.9).collect()}
    assert unmatched == {i for i, _, _ in annots} - matched
    free = {r.clip_idx for r in coverage.negative_clips(segment.clip_grid(axis, S), touched, S, 0.2).collect()}
    assert free == set(range(len(starts(75, 10, 4, False)))) - {k for _, k, _, o in want if o / 10 > 0.2}
    salvage = {(r.annot_id, r.clip_start) for r in segment.salvage_clips(coverage.unmatched(df, covered, 0.9), axis, S).collect()}
    expect = set()
    for i, a, b in annots:
        if i in unmatched:
            n = b - a + 1
            own = [a + n // 2 - 5] if n < 10 else [a + s for s in starts(n, 10, 4, False)]
            expect |= {(i, s) for s in own if s >= 0 and s + 10 <= 75}
    assert salvage == expect


def test_centralized_penalty(spark):
    cases = [(0, 1), (4, 5), (3, 4), (8, 9), (2, 7), (4, 4)]
    df = spark.createDataFrame([(a, b, 0) for a, b in cases], "a0 long, a1 long, clip_start long")
    got = [r[0] for r in df.select(coverage.centred_factor(S)).collect()]
    centre = 4.5

    def want(a, b):
        if b - a + 1 < 5 and not (a >= 2 and b <= 6) and not (a < centre < b):
            return 1 - min(abs(centre - a), abs(centre - b)) / 5
        return 1.0

    assert got == pytest.approx([want(a, b) for a, b in cases])


def test_adjusted_labels(spark):
    df = spark.createDataFrame([(0.95,), (0.5,), (0.29,)], "c double")
    assert [r[0] for r in df.select(coverage.adjusted(F.col("c"), 0.9)).collect()] == [1.0, 0.5, 0.0]


def test_label_spaces():
    space = labels.LabelSpace(["a", "b", "Other"], {"x": "a", "b": "a", "y": "q"}, negative="Other")
    assert space.class_list == ["a", "b", "Other"] and space.index_of() == {"a": 0, "b": 1, "Other": 2, "x": 0}
    opened = labels.LabelSpace(["a", "b"], {"a": "new", "b": "new", "u": "v"}, fixed=False)
    assert opened.class_list == ["new"] and opened.index_of() == {"new": 0, "a": 0, "b": 0}
    for bad in ({"a": "a"}, {"a": "b", "b": "c"}):
        with pytest.raises(ValueError):
            labels.LabelSpace(["a", "b", "c"], bad)
    assert labels.LabelSpace(["a"], negative="N", assessing=True).class_list == ["a"]


def islands(live):
    runs = []
    for c in sorted(live):
        if runs and c == runs[-1][-1] + 1:
            runs[-1].append(c)
        else:
            runs.append([c])
    return runs


def test_streaks_and_squeezing_against_brute_force(spark, rows):
    rng = random.Random(5)
    data = [("f", 0, i, i * 4, k, rng.choice([None, round(rng.random(), 3)])) for k in range(3) for i in range(60) if rng.random() < 0.8]
    df = spark.createDataFrame([(j, *d) for j, d in enumerate(data)], "score_id long, file string, channel int, clip_idx int, clip_start long, class_idx int, score double")
    live = {k: {d[2]: d[5] for d in data if d[4] == k and d[5] is not None and d[5] >= 0.3} for k in range(3)}
    want = sorted((("f", 0, k, r[0] * 4, r[-1] * 4 + 9, max(live[k][c] for c in r)) for k in live for r in islands(live[k])), key=repr)
    assert rows(streaks.detections(df, 10, 0.3), "file", "channel", "class_idx", "start_samp", "end_samp", "score") == want
    expect = []
    for k in live:
        for r in islands(live[k]):
            g = min(1 + (10 - 5) // 4, len(r))
            parts = []
            for i in range(len(r) - g + 1):
                box = r[i : i + g]
                a, b, sc = box[-1] * 4, box[0] * 4 + 9, max(live[k][c] for c in box)
                if parts and parts[-1][1] + 1 >= a:
                    parts[-1][1] = b
                    parts[-1][2].append(sc)
                else:
                    parts.append([a, b, [sc]])
            import statistics

            expect += [("f", 0, k, a, b, round(statistics.median(s), 6)) for a, b, s in parts]
    got = [(*r[:5], round(r[5], 6)) for r in rows(streaks.detections(df, 10, 0.3, squeeze=(4, 5)), "file", "channel", "class_idx", "start_samp", "end_samp", "score")]
    assert sorted(got, key=repr) == sorted(expect, key=repr)


def test_top_class_ties_nulls_and_repeats(spark, rows):
    data = [(1, "f", 0, 0, 0, 2, 0.5), (2, "f", 0, 0, 0, 1, 0.5), (2, "f", 0, 0, 0, 1, 0.5), (3, "f", 0, 1, 4, 0, None), (4, "f", 0, 1, 4, 1, float("nan"))]
    df = spark.createDataFrame(data, "score_id long, file string, channel int, clip_idx int, clip_start long, class_idx int, score double")
    assert rows(streaks.top_class(streaks.live_scores(df))) == [("f", 0, 0, 0, 1, 0.5)]


def test_scaled_score_and_numbering(spark, rows):
    with pytest.raises(ValueError):
        streaks.scaled_score(F.col("x"), 1)
    durations = spark.createDataFrame([("d", "a", 10.0), ("d", "b", 5.0), ("d", "c", 1.0), ("e", "a2", 3.0)], "dir string, file string, duration_s double")
    found = spark.createDataFrame([("a",), ("a",), ("c",)], "file string")
    got = rows(streaks.combined_numbering(durations, found, "dir"))
    assert got == [("d", "a", 0.0, 0, 2), ("d", "b", 10.0, 2, 0), ("d", "c", 15.0, 2, 1), ("e", "a2", 0.0, 0, 0)]


def test_union_coverage_against_brute_force(spark):
    rng = random.Random(7)
    mk = lambda n, salt: [(rng.choice("ab"), i, b := rng.randrange(0, 200), b + rng.choice([0, 3, 40, 130])) for i in range(n)]
    base, items = mk(30, 0), mk(40, 1)
    schema = "k string, id long, b double, e double"
    df = lambda x: spark.createDataFrame([(k, i, float(b), float(e)) for k, i, b, e in x], schema)
    got = {r.id: r.covered for r in matching.union_coverage(df(base), df(items), ["k"]).collect()}
    for k, i, b, e in base:
        units = {u for kk, _, x, y in items if kk == k for u in range(max(b, x), min(e, y))}
        assert got[i] == pytest.approx(len(units))
    t, d = matching.match_detections(df(base), df(items), ["k"])
    assert all(r.recalled for r in t.filter("b = e").collect())
    assert t.count() == 30 and d.count() == 40


def test_clip_level_counts_against_brute_force(spark):
    rng = random.Random(9)
    data = [(rng.randrange(2), rng.choice([None, rng.randrange(0, 101) / 100]), rng.choice([0.0, 0.3, 1.0])) for _ in range(200)]
    counts = metrics.clip_counts(spark.createDataFrame(data, "class_idx int, score double, cov double"), min_fraction=0.9, max_nonmatch=0.1).collect()
    assert len(counts) == 42
    for r in counts:
        own = [(s, c) for k, s, c in data if k == r.class_idx]
        assert r.tp == sum(1 for s, c in own if s is not None and s >= r.threshold and c >= 0.9)
        assert r.tp_plus_fp == sum(1 for s, c in own if s is not None and s >= r.threshold and (c >= 0.9 or c <= 0.1))
        assert r.recall_den == sum(1 for _, c in own if c >= 0.9)


def test_ratios_leave_out_classes_without_truth(spark, rows):
    c = spark.createDataFrame([(0.5, 0, 0, 0, 0, 0), (0.5, 1, 1, 0, 1, 2)], "threshold double, class_idx int, tp long, tp_plus_fp long, recall_num long, recall_den long")
    assert rows(metrics.ratios(c)) == [(0.5, 1, None, 0.5)]
    assert rows(metrics.overall(c)) == [(0.5, None, 0.5)]


def test_picks_weights_and_one_hot(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(41)], "id long, c int")
    got = sampling.pick_per_class(df, "c", "id", 1, cap=10, validation=0.25).collect()
    assert len(got) == 20 and sum(r.part == "validation" for r in got) == 4
    assert {r.id for r in got} == {r.id for r in sampling.pick_per_class(df.repartition(7), "c", "id", 1, cap=10).collect()}
    assert {r.c for r in sampling.classes_with(df, "c", 21).collect()} == {0}
    assert {r.c: r.weight for r in sampling.class_weights(df, "c").collect()} == pytest.approx({0: 41 / 42, 1: 41 / 40})
    hot = spark.createDataFrame([([0.1, 0.7, 0.7],), (None,)], "x array<double>").select(sampling.one_hot(F.col("x")))
    assert [r[0] for r in hot.collect()] == [[0.0, 1.0, 0.0], None]


def test_empty_tables(spark):
    axis = spark.createDataFrame([], "file string, channel int, n bigint")
    assert segment.clip_grid(axis, S).count() == 0
    scores = spark.createDataFrame([], "score_id long, file string, channel int, clip_idx int, clip_start long, class_idx int, score double")
    assert streaks.detections(scores, 10, squeeze=(4, 5)).count() == 0
    assert sampling.class_weights(spark.createDataFrame([], "c int"), "c").count() == 0
