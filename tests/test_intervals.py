import random

from pyspark.sql import functions as F

from tidegrid.operators.intervals import annotated_periods, periods_and_gaps

SCHEMA = "k string, b bigint, e bigint"


def brute(data):
    out = []
    for k in {k for k, _, _ in data if k is not None}:
        merged = []
        for b, e in sorted((b, e) for kk, b, e in data if kk == k and b is not None and e is not None and e >= b):
            if merged and b <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([b, e])
        out += [(k, "period", b, e) for b, e in merged] + [(k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:], strict=False)]
    return sorted(out, key=repr)


def run(spark, data, bits):
    return periods_and_gaps(spark.createDataFrame(data, SCHEMA), ["k"], F.col("b"), F.col("e"), bits)


def test_random_against_brute_force_across_shard_edges(spark, rows):
    rng = random.Random(1)
    for bits in (3, 6, 21):
        data = [(rng.choice("abc"), b := rng.randrange(-200, 400), b + rng.choice([0, 0, 1, 3, 17, 90, *([300] if bits == 3 else [])])) for _ in range(120)]
        assert rows(run(spark, data, bits)) == brute(data)


def test_touching_nested_and_points(spark, rows):
    data = [("a", 0, 4), ("a", 4, 9), ("a", 2, 3), ("a", 11, 11), ("a", 10, 10), ("b", 5, 5), ("b", 5, 5)]
    assert rows(run(spark, data, 3)) == brute(data)


def test_nulls_reversed_empty_and_hot_key(spark, rows):
    data = [(None, 1, 2), ("a", None, 2), ("a", 1, None), ("a", 5, 1)]
    assert rows(run(spark, data, 4)) == []
    assert rows(run(spark, [], 4)) == []
    hot = [("h", i % 50 * 3, i % 50 * 3 + 1) for i in range(5000)] + [("c", 0, 1)]
    assert rows(run(spark, hot, 4)) == brute(hot)


def test_annotations_round_and_ignore_extra_columns(spark, rows):
    data = [(1, "f", 0, 1.0000000001, 2.0, "x", "p"), (1, "f", 0, 1.0000000001, 2.0, "x", "q"), (2, "f", 0, 2.0000000002, 2.0, "x", None), (3, "f", 0, 3.0, 2.5, "x", ""), (4, "f", None, 1.0, 2.0, "x", ""), (5, "f", 0, float("nan"), 2.0, "x", ""), (6, "f", 0, 1.0, float("inf"), "x", "")]
    df = spark.createDataFrame(data, "annot_id long, file string, channel int, begin_s double, end_s double, label string, kind string")
    assert rows(annotated_periods(df)) == [("f", 0, "x", "period", 1000, 2000)]


def test_rows_that_span_many_shards(spark, rows):
    rng = random.Random(7)
    for _ in range(3):
        data = [(rng.choice("ab"), b := rng.randrange(-3000, 3000), b + rng.choice([0, 1, 5, 200, 900])) for _ in range(25)]
        assert rows(run(spark, data, 3)) == brute(data)
    far = [("a", 0, 10**16), ("a", 5, 6), ("a", 10**16 + 2, 10**16 + 3), ("b", -(10**15), 0), ("b", 0, 10**15), ("c", 1, 2**62)]
    assert rows(run(spark, far, 21)) == brute(far[:5])


def test_entity_with_most_rows_and_an_end_far_off(spark, rows):
    data = [(i, "f", 0, i * 2.0, i * 2.0 + (1.0 if i % 7 else 1e13), "hot" if i % 10 else "cold") for i in range(2000)]
    df = spark.createDataFrame(data, "annot_id long, file string, channel int, begin_s double, end_s double, label string")
    got = rows(annotated_periods(df).filter("kind = 'period'").groupBy("label").count())
    assert got == [("cold", 1), ("hot", 7)]  # six short ones lie before the first far end
