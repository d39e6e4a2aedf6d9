from collections import Counter

import numpy as np
import pytest

from tidegrid.llm import quota_sample as Q

CLIPS = "clip_id long, labels array<float>, split string, plan_id int"
TARGETS = "plan_id int, class_idx int, fraction double, min_clips int, sample_size long"


def clips(spark, counts, split="train"):
    rows, i = [], 0
    for c, n in counts.items():
        for _ in range(n):
            rows.append((i, [1.0 if k == c else 0.2 for k in range(4)], split, 7))
            i += 1
    return spark.createDataFrame(rows, CLIPS)


def test_class_of_labels(spark):
    df = spark.createDataFrame([(1, [0.5, 0.9, 0.9], "train", 0), (2, [0.0, 0.0], "train", 0), (3, None, "train", 0), (4, [float("nan"), 0.1], "train", 0), (5, [], "train", 0), (6, [1.0], "test", 0), (7, [None, 0.3], "train", 0)], CLIPS)
    assert {r.clip_id: r.class_idx for r in Q.labelled_clips(df).collect()} == {1: 1, 4: 1, 7: 1}


def test_newton_reaches_the_total_within_bounds():
    calibrate = lambda f, floor, n, size: Q.calibrate(np.array(f), np.array(floor), np.array(n), size)
    assert calibrate([0.5, 0.3, 0.2], [0, 0, 0], [1000, 900, 800], 100) == pytest.approx([50, 30, 20])
    # a floor takes from the others, an exhausted class leaves to them
    assert calibrate([0.5, 0.3, 0.2, 0.0], [0, 0, 30, 2], [1000, 20, 500, 1], 100) == pytest.approx([49, 20, 30, 1])
    assert calibrate([0.5, 0.5], [0, 0], [1000, 10], 100) == pytest.approx([90, 10])
    # floors alone exceed the size; too few at hand in all; nothing wanted
    assert calibrate([0.9, 0.1], [80, 70], [500, 500], 100) == pytest.approx([80, 70])
    assert calibrate([0.9, 0.1], [0, 0], [5, 6], 100) == pytest.approx([5, 6])
    assert calibrate([0.0, 0.0], [0, 0], [5, 6], 100) == pytest.approx([0, 0])
    rng = np.random.default_rng(0)
    for _ in range(200):
        k = rng.integers(1, 12)
        n, floor = rng.integers(0, 5000, k), rng.integers(0, 60, k) * rng.integers(0, 2, k)
        f = rng.dirichlet(np.full(k, 0.4))
        got = Q.calibrate(f, floor, n, 1000)
        assert (got <= n + 1e-6).all() and (got >= np.minimum(floor, n) - 1e-6).all()
        feasible = np.where(f > 0, n, np.minimum(floor, n)).sum() >= 1000 >= np.minimum(floor, n).sum()
        assert not feasible or got.sum() == pytest.approx(1000, rel=1e-6)


def test_sizes_and_repeated_clips(spark):
    df = clips(spark, {0: 2500, 1: 3006, 2: 40})
    df = df.union(df.filter("clip_id % 3 = 0")).union(df.limit(500))
    targets = spark.createDataFrame([(p, c, f, m, 500 + p) for p in range(6) for c, f, m in ((0, 0.4403, 0), (1, 0.1, 120 + p), (2, 0.4597, 0))], TARGETS)
    assert {r.class_idx: r.at_hand for r in Q.plan_report(df, targets).filter("plan_id = 0").collect()} == {0: 2500, 1: 3006, 2: 40}
    got = [tuple(r) for r in Q.draw(df, targets).collect()]
    size = Counter(p for p, _, _ in got)
    assert len(got) == len(set(got)) and all(abs(size[p] - (500 + p)) <= 1 for p in range(6))


def test_gaps_and_sample(spark):
    df = clips(spark, {0: 5000, 1: 300, 2: 8})
    targets = spark.createDataFrame([(0, 0, 0.5, 0, 400), (0, 1, 0.4999, 0, 400), (0, 2, 0.0001, 10, 400), (1, 0, 0.7, 0, 33), (1, 1, 0.3, 0, 33), (1, 3, 0.0, 1, 33), (2, None, 0.5, 0, 9)], TARGETS)
    assert sorted(map(tuple, Q.unreachable(df, targets).collect())) == [(0, 2), (1, 3)]
    report = {(r.plan_id, r.class_idx): r for r in Q.plan_report(df, targets).collect()}
    assert report[0, 1].wanted == 200 and report[0, 2].gap == 2
    got = [tuple(r) for r in Q.draw(df, targets).collect()]
    assert len(got) == len(set(got))
    drawn = Counter((p, c) for p, _, c in got)
    for k, r in report.items():
        assert abs(drawn[k] - r.expected) < 1
    assert drawn[0, 2] == 8
    again = sorted(tuple(r) for r in Q.draw(df.repartition(3), targets).collect())
    assert again == sorted(got)


def test_empty(spark):
    targets = spark.createDataFrame([(0, 0, 1.0, 0, 5)], TARGETS)
    none = spark.createDataFrame([], CLIPS)
    assert [tuple(r) for r in Q.unreachable(none, targets).collect()] == [(0, 0)]
    assert Q.draw(none, targets).count() == 0
    assert Q.unreachable(none, spark.createDataFrame([], TARGETS)).count() == 0


def test_a_binding_floor_of_a_large_class_is_met_exactly(spark):
    df = clips(spark, {0: 700, 1: 3006, 2: 900})
    plans = range(40)
    targets = spark.createDataFrame([(p, c, f, m, 500) for p in plans for c, f, m in ((0, 0.4403, 0), (1, 0.1, 120), (2, 0.4597, 0))], TARGETS)
    got = Counter((r.plan_id, r.class_idx) for r in Q.draw(df, targets).collect())
    assert {p: got[p, 1] for p in plans} == dict.fromkeys(plans, 120)
