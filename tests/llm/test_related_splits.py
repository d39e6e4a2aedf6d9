import random

from tidegrid.llm import related_splits as R

PAIRS = "map_id long, audio_path string, annot_path string"


def components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    def name(p):
        last = (p or "").replace("\\", "/").rsplit("/", 1)[-1].strip().lower()
        return last or None

    for a, t in pairs:
        a, t = name(a), name(t)
        if a:
            find(("a", a))
        if a and t:
            parent[find(("a", a))] = find(("t", t))
    groups = {}
    for k, v in list(parent):
        if k == "a":
            groups.setdefault(find((k, v)), []).append(v)
    return sorted((x, min(g)) for g in groups.values() for x in g)


def run(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], PAIRS)
    return sorted(map(tuple, R.related_files(df).select("file", "group_file").collect()))


def test_random_graphs_and_chains(spark):
    rng = random.Random(2)
    for n in (5, 40):
        pairs = [(f"x/F{rng.randrange(n)}.wav", f"t{rng.randrange(n)}.txt") for _ in range(n)]
        assert run(spark, pairs) == components(pairs)
    chain = [(f"{i:03}.wav", f"t{j}.txt") for i in range(60) for j in (i, i + 1)]
    assert run(spark, chain) == components(chain)


def test_paths_nulls_and_hot_table(spark):
    pairs = [("C:\\x\\A.wav ", "t.txt"), ("/y/a.WAV", "u.txt"), ("b.wav", "  T.TXT"), ("c.wav", None), ("d.wav", " "), (None, "t.txt"), ("dir/", "t.txt"), ("e.wav", "z/")]
    assert run(spark, pairs) == components(pairs) == [("a.wav", "a.wav"), ("b.wav", "a.wav"), ("c.wav", "c.wav"), ("d.wav", "d.wav"), ("e.wav", "e.wav")]
    hot = [(f"{i}.wav", "hot.txt") for i in range(300)]
    assert run(spark, hot) == components(hot)
    assert run(spark, []) == []


def test_assignment_keeps_groups_and_fractions(spark):
    rng = random.Random(3)
    pairs = [(f"f{i}.wav", f"t{i // 2}.txt") for i in range(200)]
    sel = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], PAIRS)
    records = spark.createDataFrame([(i, f"F{rng.randrange(1500)}.wav", "x") for i in range(4000)] + [(9999, None, "x")], "clip_id long, file string, split string")
    targets = spark.createDataFrame([("train", 0.7), ("test", 0.3), ("none", 0.0), (None, 0.5)], "split string, fraction double")
    rows = R.assign_splits(records, "clip_id", "file", sel, targets).collect()
    assert len(rows) == 4001
    by_group = {}
    for r in rows:
        by_group.setdefault(r.group_file, set()).add(r.split)
    assert all(len(s) == 1 for s in by_group.values())
    assert 0.6 < sum(r.split == "train" for r in rows) / len(rows) < 0.8


def test_file_of_a_record_is_read_like_a_path(spark):
    pairs = spark.createDataFrame([("a/One.wav", "t.txt"), ("two.wav", "T.txt")], "audio_path string, annot_path string")
    records = spark.createDataFrame([(1, "one.wav"), (2, "\tTWO.wav\u00a0"), (3, "x\\two.wav"), (4, None)], "id long, f string")
    targets = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split string, fraction double")
    got = {r.id: r.group_file for r in R.assign_splits(records, "id", "f", pairs, targets).collect()}
    assert got[1] == got[2] == got[3] == "one.wav" and got[4] == "\0" + "4"
