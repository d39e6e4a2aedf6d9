import random

from tidegrid.llm import score_cutoff as C

SCORES = "score_id long, deployment string, score double, cutoff double"
TARGETS = "deployment string, keep_pct int, source string"


def brute(scores, targets):
    want = {}
    for d, p, _ in targets:
        if p is not None and p > 0:
            want[d] = max(want.get(d, 0), min(p, 100))
    seen = {i: (d, round(s * 1e6)) for i, d, s, _ in scores if s is not None and s == s and d is not None}
    out = []
    for d, p in want.items():
        v = sorted((x for dd, x in seen.values() if dd == d), reverse=True)
        if v:
            c = v[-(-len(v) * p // 100) - 1]
            out.append((d, c, sum(x >= c for x in v)))
    return sorted(out)


def run(spark, scores, targets):
    return sorted(map(tuple, C.source_cutoffs(spark.createDataFrame(scores, SCORES), spark.createDataFrame(targets, TARGETS)).select("deployment", "cutoff_e6", "n_kept").collect()))


def test_against_sorting_with_ties_hot_source_and_repeats(spark):
    rng = random.Random(1)
    scores = [(i, rng.choice("aaaaab"), rng.choice([rng.random(), 0.5, -1.25]), 0.0) for i in range(3000)]
    scores += scores[:50] + [(5000, "c", 0.1, 0.0), (5001, "d", None, 0.0), (5002, "d", float("nan"), 0.0), (5003, None, 0.5, 0.0)]
    targets = [("a", 37, "x"), ("b", 1, "x"), ("c", 100, "x"), ("d", 50, "x"), ("e", 50, "x"), ("a", 5, "y"), ("b", None, "z")]
    assert run(spark, scores, targets) == brute(scores, targets)


def test_same_scores_and_extremes(spark):
    scores = [(i, "a", 0.25, 0.0) for i in range(500)] + [(1000 + i, "b", i / 1000, 0.0) for i in range(7)]
    for p in (1, 50, 100, 250):
        targets = [("a", p, ""), ("b", p, "")]
        assert run(spark, scores, targets) == brute(scores, targets)
    assert run(spark, scores, [("a", 0, ""), ("b", -3, "")]) == []


def test_rows_without_id_do_not_count(spark):
    scores = [(i, "a", i / 100, 0.0) for i in range(10)]
    unknown = [(None, "a", 0.5, 0.0), (None, "a", 0.7, 0.0), (None, "b", 0.5, 0.0)]
    assert run(spark, scores + unknown, [("a", 10, ""), ("b", 50, "")]) == [("a", 90_000, 1)]


def test_empty(spark):
    assert run(spark, [], [("a", 5, "")]) == [] == run(spark, [(1, "a", 0.5, 0.0)], [])
