import random

from tidegrid.llm import leaks as L

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru") for b in ("ne", "so", "ti") for c in ("dar", "pel", "vun")]
DOCS, ITEMS = "doc_id long, text string, item_id long", "item_id long, text string, lang string"


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 5) for i, t in docs], DOCS)
    return sorted(map(tuple, L.leaked_items(d, spark.createDataFrame(items, ITEMS)).collect()))


def test_passages_of_thirteen_words_with_noise(spark):
    rng = random.Random(6)
    words = [rng.choice(WORDS) for _ in range(30)]
    item = " ".join(words)
    passage = words[8:21]
    slip = lambda w: w[:2] + w[3:]
    dirty = [slip(w) if i in (3, 7, 10) else w for i, w in enumerate(passage)]
    filler = " ".join(rng.choice(WORDS) for _ in range(200))
    docs = [
        (1, f"{filler} {' '.join(passage)} {filler}"), (2, " ".join(passage[:12])), (3, filler + "\n" + ", ".join(dirty).upper() + "."), (4, f"{' '.join(passage[:6])}-\n{' '.join(passage[6:])}".replace(passage[5] + "-\n", passage[5] + "-\n")),
        (5, " ".join(passage).replace(passage[4], passage[4][:3] + "-\n" + passage[4][3:])), (6, None), (7, ""), (8, " ".join([*passage[:4], "zzzzzz", *passage[5:]])), (9, " ".join([*passage[:4], slip(passage[4]), slip(passage[5]), *passage[6:]])), (10, item + " " + item),
    ]
    assert [d for d, _ in run(spark, docs, [(7, item, "en")])] == [1, 3, 5, 10]


def test_characters_and_unicode_forms(spark):
    import unicodedata

    rng = random.Random(8)
    item = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60))
    docs = [(1, "前文。" + item[10:35] + "。"), (2, item[10:34]), (3, "，".join(item[10:36]) + "！"), (4, item[10:20] + "\n " + item[20:40])]
    assert [d for d, _ in run(spark, docs, [(7, item, "zh")])] == [1, 3, 4]
    accents = "élan naïve façade déjà rôle über señor niño crème brûlée fête île août noël"
    assert run(spark, [(1, unicodedata.normalize("NFD", accents).upper())], [(9, accents, "fr")]) == [(1, 9)]


def test_search_misses_nothing_that_verification_accepts():
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(28)), "en") for i in range(20)]
    index = L.ItemIndex(items)
    for i, text, _ in items:
        words = text.split()
        for _ in range(10):
            a = rng.randrange(15)
            doc = [rng.choice(WORDS) for _ in range(rng.randrange(90))] + words[a : a + 13] + [rng.choice(WORDS) for _ in range(rng.randrange(90))]
            assert index.holds(doc, L.expanded(doc), i) and i in index.aligned(L.expanded(doc), index.candidates(doc, L.expanded(doc)))


def test_slips_beside_expanded_letters_and_two_in_long_words(spark):
    words = "wir standen lange frierend draußen und haben außerhalb der alten Stadtmauer auf euch gewartet".split()
    item = " ".join(words)
    put = lambda k, w: " ".join([*words[:k], w, *words[k + 1 :]])
    docs = [(1, put(7, "aßuerhalb")), (2, put(7, "ausserhlab")), (3, put(10, "Sadtmaeur")), (4, put(10, "Satmaeur")), (5, put(9, "alnten").replace("und", "nudd")), (6, put(4, "draußne").upper())]
    assert len(words) == 14 and [d for d, _ in run(spark, docs, [(7, item, "de")])] == [1, 2, 3, 6]
    assert run(spark, [(1, put(7, "aßuerhalb"))], [(7, item.replace("ß", "ss"), "de")]) == [(1, 7)]
    assert L.misspelt(L.folded_tokens("oﬃce")[0], L.folded_tokens("oﬃec")[0]) and L.misspelt(L.folded_tokens("ﬁnd")[0], "fnid"[:1] + "ind") and not L.misspelt("und", "nudd")


def test_passages_with_alternate_slips_and_in_mixed_texts_are_candidates():
    rng = random.Random(12)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(28)), "en") for i in range(20)]
    index = L.ItemIndex(items)
    for i, text, _ in items:
        for a in range(15):
            passage = [w[:2] + w[3:] if k % 2 else w for k, w in enumerate(text.split()[a : a + 13])]
            doc = [rng.choice(WORDS) + "x" for _ in range(30)] + passage + [rng.choice(WORDS) + "y" for _ in range(30)]
            assert index.holds(doc, L.expanded(doc), i) and i in index.aligned(L.expanded(doc), index.candidates(doc, L.expanded(doc)))
            mixed = [chr(0x4E00 + rng.randrange(3000)) for _ in range(20)] + text.split()[a : a + 13]
            assert index.holds(mixed, L.expanded(mixed), i) and i in index.aligned(L.expanded(mixed), index.candidates(mixed, L.expanded(mixed)))


def test_empty(spark):
    assert run(spark, [], [(1, "a b", "en")]) == [] == run(spark, [(1, "some text")], [])
