import pytest

from tidegrid.llm import canonical as C

CLASSES = [("Golden Finch", 0), ("Lesser Finch", 1), ("Golden Whale", 2), ("Lesser Whale", 3), ("Other", 4), ("Pale Owl", 5), (None, 6)]
REMAP = [("GOLFI10", "Golden Finch"), ("background", "Other"), ("FENLX20", "Saffron Lurker"), (None, "Other")]
CASES = {
    "golden finch": 0, "GOLDEN  FINCH!": 0, "Gоldеn Finch": 0, "Ｇｏｌｄｅｎ Ｆｉｎｃｈ": 0, "Gölden Fínch": 0, "goldenfinch": 0, "Finch, Golden": 0, "G. Finch": 0, "Gol. Finch": 0,
    "Goldne Fnch": 0, "Golden Finches (juv.)": 0, "Golden_Finch x3": 0, "the Lesser Whale": 3, "lesserwhael": 3, "golfi10": 0, "GO-LFI10?": 0, "GOLFI11": -1, "FENLX20": -1, "backgruond": 4,
    "OTHER": 4, "Finch": -1, "Saffron Finch": -1, "Pale Whale": -1, "Tiny Lurker": -1, "?": -1, "12": -1, "Golden Finch / Lesser Whale": -1, "Owl, pale": 5, "x" * 5000: -1,
}


def test_cases_blanks_repeats_and_exact_labels(spark):
    rows = [(i, t, i) for i, t in enumerate(CASES)] + [(0, next(iter(CASES)), None)] + [(900, None, 0), (901, " \t", 0), (902, "Golden Finch", 0), (903, "\u00a0", 0)]
    sel = spark.createDataFrame(rows, "sel_id long, tags string, class_idx int")
    got = {r.sel_id: r.class_idx for r in C.map_tags(sel, spark.createDataFrame(CLASSES, "label string, class_idx int"), spark.createDataFrame(REMAP, "src string, dst string")).collect()}
    assert {t: got[i] for i, t in enumerate(CASES)} == CASES
    assert len(got) == len(CASES)


def test_hot_value_and_empty_reference(spark):
    sel = spark.createDataFrame([(i, "goldn finch" if i % 3 else f"tag {i}") for i in range(600)], "sel_id long, tags string")
    classes, remap = spark.createDataFrame(CLASSES, "label string, class_idx int"), spark.createDataFrame(REMAP, "src string, dst string")
    got = C.map_tags(sel, classes, remap).groupBy("class_idx").count().collect()
    assert {r.class_idx: r["count"] for r in got} == {0: 400, -1: 200}
    none = C.map_tags(sel, classes.limit(0), remap.limit(0))
    assert none.count() == 600 and none.filter("class_idx <> -1").count() == 0
    assert C.map_tags(sel.limit(0), classes, remap).count() == 0


@pytest.mark.parametrize(("a", "b", "d"), [("abc", "abc", 0), ("abc", "acb", 1), ("abc", "axcb", 2), ("ab", "xaby", 2), ("", "ab", 2), ("abcd", "efgh", 3)])
def test_edit_distance(a, b, d):
    assert C.edit_distance(a, b) == d == C.edit_distance(b, a)


def test_other_scripts_and_long_tokens(spark):
    long = "pneumonoultramicroscopicsilicovolcanoconiosispseudopseudohypoparathyroidism"
    classes = spark.createDataFrame([("ザトウクジラ", 0), ("Łódź", 1), ("Ørsted", 2), (long, 3), ("белуха", 4), ("orca", 5)], "label string, class_idx int")
    swapped = long[:30] + long[31] + long[30] + long[32:-1]
    tags = {1: "ザトウクジラ!", 2: "lodz", 3: "orsted", 4: swapped, 5: long[:20] + long[24:], 6: "БЕЛУГА", 7: "оrса", 8: "шшшш", 9: "…"}
    seltab = spark.createDataFrame([(k, v) for k, v in tags.items()], "sel_id long, tags string")
    got = dict(tuple(r) for r in C.map_tags(seltab, classes, spark.createDataFrame([], "src string, dst string")).collect())
    assert got == {1: 0, 2: 1, 3: 2, 4: 3, 5: -1, 6: 4, 7: 5, 8: -1, 9: -1}


def test_segments_find_all_within_two_edits():
    import random

    rng = random.Random(5)
    for _ in range(300):
        known = "".join(rng.choice("abcdef") for _ in range(rng.randint(12, 40)))
        typed = list(known)
        for _ in range(2):
            i = rng.randrange(len(typed) - 1)
            match rng.randrange(4):
                case 0:
                    typed[i] = "z"
                case 1:
                    del typed[i]
                case 2:
                    typed.insert(i, "z")
                case 3:
                    typed[i], typed[i + 1] = typed[i + 1], typed[i]
        typed = "".join(typed)
        assert C.edit_distance(typed, known) <= 2 and C.typed_keys(typed) & C.known_keys(known)
