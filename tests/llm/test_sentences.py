import random

import pytest

from tidegrid.llm import sentences as S

STARTS = ["Before dawn", "During the storm", "After the tide", "On the third evening", "Last winter", "Around midnight"]


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(0)
    mid = ["the crew from Kelu saw Dr. Talu near the pier", "a boat from Fepa passed St. Ramo with no. 4 aboard", "someone heard e.g. a whistle in the bay", "the pilot met Mrs. Nare off the reef"]
    texts = [" ".join(f"{rng.choice(STARTS)} {rng.choice(mid)}{rng.choice('.!?')}" for _ in range(6)) for _ in range(150)]
    zh = ["大潮过后测量船报告了哨声。午夜前后站务员错过了颤音。去年冬天学员描述了长鸣。" for _ in range(20)]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts + zh)], "doc_id long, text string, begin_pos int")
    return S.learn(df)


def cut(text, model):
    return [text[a:b] for a, b in S.sentences(text, model)]


def test_learned_entries(model):
    assert {("en", "dr"), ("en", "mrs"), ("en", "st"), ("en", "no")} <= model.abbreviations
    assert ("en", "during", "the") in model.pairs


CASES = [
    ["Before dawn Dr. Talu saw no. 4.", "Last winter it left."],
    ["“Listen! During the storm it sang. Stop!” said Kelu that evening.", "After the tide it stopped."],
    ["(Last winter the boat left.)", "\"Before dawn it came back.\"", "On the third evening all slept."],
    ["Notes on a song", "Around midnight it sang (cf. no. 3, p. 2.) again."],
    ["Last winter the v1.2.3 of file_1.wav was lost…", "8. On the third evening a… whistle came?!"],
    ["before dawn a boat passed st. ramo.", "during the storm it sank!", "last winter dr. talu left"],
    ["大潮过后测量船报告了哨声……", "“听！午夜前后站务员错过了颤音。”，他当晚写道。", "「去年冬天学员描述了长鸣。」", "午夜前后站务员在clip_1.wav中听到了！？"],
    ["तूफ़ान के दौरान नाव खो गई।", "भोर से पहले वह लौटी?", "“सुनो! वह आई।”, केलू ने कहा।"],
]


@pytest.mark.parametrize("units", CASES)
def test_units(model, units):
    for glue in (" ", "\n", "  \t"):
        if units[0].startswith("Notes"):
            glue = "\n \n"
        assert cut(glue.join(units), model) == units


def test_missing_blank_and_break_inside(model):
    assert cut("Last winter it left.During the storm\nit sang.", model) == ["Last winter it left.", "During the storm\nit sang."]
    assert cut("“Before dawn it sang. Last win", model) == ["“Before dawn it sang. Last win"]


def test_thai(model):
    text = "เรือสำรวจรายงานเสียงแปลก  ยามกลางคืนพลาดเสียง ราว 17 นาทีต่อมาเรือกลับ บ่อย ๆ ครั้ง\n\nในไฟล์ clip_6.wav นั้นจบ"
    assert cut(text, model) == ["เรือสำรวจรายงานเสียงแปลก", "ยามกลางคืนพลาดเสียง", "ราว 17 นาทีต่อมาเรือกลับ", "บ่อย ๆ ครั้ง", "ในไฟล์ clip_6.wav นั้นจบ"]


def test_frame_blanks_long_and_repeated(spark, model):
    rows = [(1, None, 0), (2, " \u00a0\n", 0), (3, "Last winter it left. Before dawn it came.", 0), (3, "Last winter it left. Before dawn it came.", 1), (4, "é" * 20000, 0), (5, "...", 0), (6, "\u00a0 (x) ", 0)]
    got = sorted(map(tuple, S.sentence_units(spark.createDataFrame(rows, "doc_id long, text string, end_pos int"), model=model).collect()))
    assert got == [(3, 0, 20), (3, 21, 41), (4, 0, 20000), (5, 0, 3), (6, 2, 5)]
    assert S.sentence_units(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_words_and_further_scripts():
    m = S.Model()
    m.abbreviations = {("en", "abbreviationally")}
    m.words = {("en", "then")}
    text = "He went abbreviationally. Then she came. It ended there."
    assert [text[a:b] for a, b in S.sentences(text, m)] == ["He went abbreviationally.", "Then she came.", "It ended there."]
    assert [S.language(t) for t in ("καλημέρα κόσμε", "مرحبا بالعالم", "שלום עולם", "안녕하세요 여러분", "12 !?")] == ["el", "ar", "he", "ko", "xx"]
    urdu = "یہ پہلا جملہ ہے۔ یہ دوسرا ہے۔"
    assert [urdu[a:b] for a, b in S.sentences(urdu, m)] == ["یہ پہلا جملہ ہے۔", "یہ دوسرا ہے۔"]
