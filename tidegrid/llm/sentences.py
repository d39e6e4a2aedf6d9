"""Sentence boundaries across languages and scripts, learned without supervision.

Statistics over all documents are kept per language: which words begin sentences after certain
breaks (sentence starters), which words carry a period although the sentence goes on
(abbreviations) and which pairs stand around such periods (collocations). Each is accepted by a
log-likelihood ratio, computed on counts that Spark adds up with map-side combining; only accepted
entries are broadcast. A second pass classifies every possible end of a sentence with them. What is
quoted or bracketed is skipped over; closing marks and empty lines are handled by fixed rules. Thai
has no end marks: runs of blanks end its units.

The language of a text is found from its letters and, in Latin script, from its commonest words,
since given language names can be wrong or missing.

Defined results: null and blank texts give no row; places are code points; a text without any end
mark is one unit; a text in no known language uses the statistics of unknown ones. Repeated rows of
a doc_id give their units once each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.store import durable

#: Accepted entries of the model that may be broadcast.
MAX_MODEL = 500_000
ABBREVIATION_SCORE, COLLOCATION_LLR, STARTER_LLR = 0.3, 7.88, 20.0

#: The commonest words of the languages in Latin script.
COMMON = {
    "en": frozenset("the of and a an in to from on at off with was that".split()),
    "de": frozenset("der die das den dem des ein eine einen aus von am im und in bei".split()),
    "fr": frozenset("le la les de du des un une a à et dans au près".split()),
    "es": frozenset("el la los las de del un una y en al por junto".split()),
}

#: Words of one language alone count twice.
_WEIGHTS = {k: {w: 1 if any(w in other for j, other in COMMON.items() if j != k) else 2 for w in own} for k, own in COMMON.items()}

END = ".!?…。！？।॥．｡؟‽۔։።"
CLOSERS = "”’»«\"')]」』）】》›"
OPENERS = "“„‘‚«»\"'([「『（【《‹¿¡"
GOES_ON = frozenset(",;:)，、；：）—–")
PAIRS = {"“": "”", "„": "“”", "‘": "’", "‚": "‘", "«": "»", "»": "«", "「": "」", "『": "』", "（": "）)", "(": ")）", "[": "]", "【": "】", "《": "》", "‹": "›", '"': '"'}

_EMPTY_LINE = regex.compile(r"\n[^\S\n]*\n\s*")
_MARK = regex.compile(r"[.…．]+|[!?。！？।॥｡؟‽۔։።.…]+|[“„‘‚«»\"(\[「『（【《‹]")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_BEFORE = regex.compile(r"[\p{L}\p{M}\p{N}.]+$")
_LIST = regex.compile(r"\(?\p{N}{1,3}[.)]\s+")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_THAI_GAP = regex.compile(r"\s+")
#: Scripts that decide the language or stand for it; in Latin script words decide.
SCRIPTS = {
    "th": r"\p{Thai}", "cjk": r"[\p{Han}\p{Hiragana}\p{Katakana}]", "ru": r"\p{Cyrillic}", "hi": r"\p{Devanagari}", "latin": r"\p{Latin}", "el": r"\p{Greek}", "ar": r"\p{Arabic}",
    "he": r"\p{Hebrew}", "ko": r"\p{Hangul}", "hy": r"\p{Armenian}", "ka": r"\p{Georgian}", "bn": r"\p{Bengali}", "ta": r"\p{Tamil}", "te": r"\p{Telugu}", "am": r"\p{Ethiopic}",
}
_RUNS = {k: regex.compile(f"{v}+") for k, v in SCRIPTS.items()}
_OTHER = regex.compile(r"[^\p{Latin}\P{L}]")
_SURE = regex.compile(r"(?:(?<=\p{Ll}{4})\.|[!?][\"”»’)]*|।)\s+(?=[\"“„«»‘(¿¡]*[\p{Lu}\p{Devanagari}])")
_SURE_CJK = regex.compile(r"[。！？](?=[\p{Han}\p{Hiragana}\p{Katakana}])")


def language(text: str) -> str:
    """Language (or script, where that is enough) by the letters and commonest words."""
    if text.isascii() or not _OTHER.search(text):
        script = "latin" if _RUNS["latin"].search(text) else None
    else:
        seen = {k: n for k, p in _RUNS.items() if (n := sum(map(len, p.findall(text))))}
        script = max(sorted(seen), key=lambda k: seen[k] * (2 if k in ("cjk", "th") else 1)) if seen else None
    if script is None:
        return "xx"
    if script == "cjk":
        return "ja" if regex.search(r"[\p{Hiragana}\p{Katakana}]", text) else "zh"
    if script != "latin":
        return script
    words = Counter(_WORD.findall(text.casefold()))
    score = {k: sum(words[w] * n for w, n in own.items() if w in words) for k, own in _WEIGHTS.items()}
    best = max(sorted(score), key=score.get)
    return best if score[best] else "xx"


def _pair(text: str, at: int) -> tuple[str, str]:
    """The next two words from a place, folded; words with digits are '#'."""
    fold = lambda w: "#" if any(map(str.isnumeric, w)) else w.casefold()
    m = _WORD.search(text, at)
    if not m:
        return "", ""
    n = _WORD.search(text, m.end())
    return fold(m[0]), fold(n[0]) if n and n.start() - m.end() < 12 else ""


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Stretches between empty lines."""
    out, at = [], 0
    for m in _EMPTY_LINE.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(text))]


def certain_starts(text: str, lang: str) -> list[int]:
    """Places where a sentence begins beyond doubt."""
    starts = [m.start() for a, b in paragraphs(text) if (m := _WORD.search(text, a, b))]
    return starts + [m.end() for m in (_SURE_CJK if lang in ("zh", "ja") else _SURE).finditer(text)]


def log_likelihood(a: float, total_a: float, b: float, total_b: float) -> float:
    """Dunning's ratio for ``a`` of ``total_a`` against ``b`` of ``total_b``; 0 if not more frequent."""
    if not total_a or not total_b or a / total_a <= b / total_b:
        return 0.0
    p = (a + b) / (total_a + total_b)

    def likely(k: float, n: float, q: float) -> float:
        q = min(max(q, 1e-12), 1 - 1e-12)
        return k * math.log(q) + (n - k) * math.log(1 - q)

    return 2 * (likely(a, total_a, a / total_a) + likely(b, total_b, b / total_b) - likely(a, total_a, p) - likely(b, total_b, p))


@dataclass
class Model:
    """Accepted statistics: all keys are (language, ...)."""

    pairs: set = field(default_factory=set)
    words: set = field(default_factory=set)
    abbreviations: set = field(default_factory=set)
    collocations: set = field(default_factory=set)

    def starts(self, text: str, at: int, lang: str) -> bool:
        """Does a sentence begin here? A list number belongs to the sentence it opens."""
        while at < len(text) and (text[at] in OPENERS or text[at].isspace()):
            at += 1
        if lang in ("zh", "ja"):
            return (lang, text[at : at + 2]) in self.pairs
        if m := _LIST.match(text, at):
            at = m.end()
            while at < len(text) and text[at] in OPENERS:
                at += 1
        a, b = _pair(text, at)
        return (lang, a, b) in self.pairs or (lang, a) in self.words

    def abbreviates(self, word: str, lang: str) -> bool:
        w = word.casefold()
        return "." in w or (len(w) == 1 and w.isalpha()) or (lang, w) in self.abbreviations


def _count(documents: DataFrame, counter) -> DataFrame:
    """Counts (kind, lang, key, n) that ``counter(text, lang) -> Counter`` gives, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        send = lambda: pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in total], pa.string()) for i in range(3)), pa.array(total.values(), pa.int64())], names=["kind", "lang", "key", "n"])
        for batch in batches:
            for value in batch.column(0):
                if text := value.as_py():
                    lang = language(text)
                    for (kind, key), n in counter(text, lang).items():
                        total[kind, lang, key] += n
            if len(total) > 200_000:
                yield send()
                total.clear()
        yield send()

    return documents.mapInArrow(run, "kind string, lang string, key string, n bigint").groupBy("kind", "lang", "key").agg(F.sum("n").alias("n"))


def _starter_counts(text: str, lang: str) -> Counter:
    seen: Counter = Counter()
    for at in certain_starts(text, lang):
        if lang in ("zh", "ja"):
            seen["pair", text[at : at + 2]] += 1
        else:
            a, b = _pair(text, at)
            seen["pair", f"{a} {b}"] += 1
            seen["first", a] += 1
        seen["all", ""] += 1
    if lang not in ("zh", "ja"):
        for m in _WORD.finditer(text):
            seen["word", m[0].casefold()] += 1
            seen["words", ""] += 1
    return seen


def _period_counts(model: Model):
    def counts(text: str, lang: str) -> Counter:
        seen: Counter = Counter()
        if lang in ("zh", "ja", "th"):
            return seen
        for m in _WORD.finditer(text):
            w, end = m[0].casefold(), m.end()
            dotted = text[end : end + 1] == "." and text[end + 1 : end + 2] not in (".", "…")
            seen["dots" if dotted else "plains", ""] += 1
            if any(map(str.isnumeric, w)):
                if not dotted:
                    continue
                w = "#"
            if not dotted:
                seen["plain", w] += 1
                continue
            after = end + 1
            while after < len(text) and text[after].isspace():
                after += 1
            seen["dot", w] += 1
            if after > end + 1 and after < len(text) and not model.starts(text, after, lang) or text[after : after + 1] in tuple(GOES_ON):
                seen["middle", w] += 1
                a, _ = _pair(text, after)
                seen["around", f"{w} {a}"] += 1
        return seen

    return counts


def _ratio(a: Column, total_a: Column, b: Column, total_b: Column) -> Column:
    """``log_likelihood`` as a column expression."""
    p = (a + b) / (total_a + total_b)
    safe = lambda q: F.least(F.greatest(q, F.lit(1e-12)), F.lit(1 - 1e-12))
    likely = lambda k, n, q: k * F.log(safe(q)) + (n - k) * F.log(1 - safe(q))
    value = 2 * (likely(a, total_a, a / total_a) + likely(b, total_b, b / total_b) - likely(a, total_a, p) - likely(b, total_b, p))
    return F.when(a / total_a > b / total_b, value).otherwise(0.0)


def _one(counts: DataFrame, kind: str, name: str, keyed: bool = True) -> DataFrame:
    return counts.filter(F.col("kind") == kind).select("lang", *(["key"] if keyed else []), F.col("n").cast("double").alias(name))


def _gather(df: DataFrame) -> list:
    rows = df.limit(MAX_MODEL + 1).collect()
    if len(rows) > MAX_MODEL:
        raise ValueError(f"more than {MAX_MODEL} accepted entries")
    return rows


def learn(documents: DataFrame, text_col: str = "text") -> Model:
    """The model of a corpus; every text counts."""
    texts = documents.select(text_col)
    counts = durable(_count(texts, _starter_counts), "starters")
    total, words = _one(counts, "all", "total", False), _one(counts, "words", "words", False)
    pairs = _one(counts, "pair", "n").join(F.broadcast(total), "lang").filter("n >= greatest(2, 2e-4 * total)")  # totals: one row per language
    first = _one(counts, "first", "n").join(_one(counts, "word", "w"), ["lang", "key"]).join(F.broadcast(total), "lang").join(F.broadcast(words), "lang")
    llr = _ratio(F.col("n"), F.col("total"), F.greatest(F.col("w") - F.col("n"), F.lit(0)), F.greatest(F.col("words") - F.col("total"), F.lit(1)))
    first = first.withColumn("llr", llr).filter(f"n >= 3 and n >= 0.5 * w and llr >= {STARTER_LLR}")
    model = Model()
    for r in _gather(pairs.select("lang", "key")):
        model.pairs.add((r["lang"], r["key"]) if r["lang"] in ("zh", "ja") else (r["lang"], *r["key"].split(" ", 1)))
    model.words = {(r["lang"], r["key"]) for r in _gather(first.select("lang", "key"))}
    counts = durable(_count(texts, _period_counts(model)), "periods")
    dots, plains = _one(counts, "dots", "dots", False), _one(counts, "plains", "plains", False)
    seen = _one(counts, "dot", "d").join(_one(counts, "plain", "p"), ["lang", "key"], "left").join(_one(counts, "middle", "m"), ["lang", "key"]).join(F.broadcast(dots), "lang").join(F.broadcast(plains), "lang")
    seen = seen.fillna(0.0, ["p"])
    # rarer words have less proof, longer ones are rarely abbreviated, and use without a period speaks against it
    own_rate = _ratio(F.col("d"), F.col("d") + F.col("p"), F.greatest(F.col("dots") - F.col("d"), F.lit(0)), F.greatest(F.col("dots") + F.col("plains") - F.col("d") - F.col("p"), F.lit(1)))
    score = own_rate * F.exp(-F.length("key")) * F.pow(F.length("key").cast("double"), -F.least(F.col("p") / F.greatest(F.col("d") / 20, F.lit(1.0)), F.lit(50.0)))
    short = seen.filter("key <> '#'").withColumn("score", score).filter(f"score >= {ABBREVIATION_SCORE} and m >= 0.1 * d")
    model.abbreviations = {(r["lang"], r["key"]) for r in _gather(short.select("lang", "key"))}
    around = _one(counts, "around", "n").withColumns({"a": F.split_part("key", F.lit(" "), F.lit(1)), "b": F.split_part("key", F.lit(" "), F.lit(2))}).filter("b <> ''")
    # words before numbers: what follows is no list number
    numbered = around.filter("b = '#'").join(_one(counts, "dot", "d").withColumnRenamed("key", "a"), ["lang", "a"]).filter("n >= 3 and n >= 0.3 * d")
    around = around.filter("b <> '#'")
    around = around.join(_one(counts, "dot", "d").withColumnRenamed("key", "a"), ["lang", "a"]).join(_one(counts, "plain", "p").withColumnRenamed("key", "b"), ["lang", "b"]).join(F.broadcast(plains), "lang")
    around = around.withColumn("llr", _ratio(F.col("n"), F.col("d"), F.greatest(F.col("p") - F.col("n"), F.lit(0)), F.col("plains"))).filter(f"n >= 3 and llr >= {COLLOCATION_LLR}")
    model.collocations = {(r["lang"], r["a"], r["b"]) for r in _gather(around.select("lang", "a", "b").union(numbered.select("lang", "a", "b")))}
    # texts too short to tell their language use what holds in any language of their script
    for own in (model.pairs, model.words, model.abbreviations, model.collocations):
        own |= {("xx", *k[1:]) for k in own if k[0] in COMMON}
    return model


def quoted(text: str, a: int, b: int, last: bool) -> dict[int, int]:
    """Opening marks of a paragraph with the place of their closing mark.

    In the last paragraph a mark that is never closed reaches to the end if the text is cut off.
    """
    found: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for i in range(a, b):
        c = text[i]
        if c not in PAIRS and c not in "”’»«」』）)]】》›":
            continue
        own = next((k for k in range(len(stack) - 1, -1, -1) if c in PAIRS[stack[k][0]]), None)
        after, before = text[i + 1 : i + 2], text[i - 1 : i] if i > a else ""
        if c == "’" and (after.isalnum() or own is None):
            continue
        if own is not None and not (c == "“" and stack[own][0] != "„"):
            found[stack[own][1]] = i
            del stack[own:]
        elif c in PAIRS and after and (not before.isalnum() or c in "「『（【《"):
            if c == "‘" and not (after.strip() or False):
                continue
            stack.append((c, i))
    if last and stack and text[a:b].rstrip()[-1:] not in END + CLOSERS:
        found[stack[0][1]] = b
    return found


def _blank_after(text: str, i: int, b: int) -> int:
    while i < b and text[i].isspace():
        i += 1
    return i


def _thai(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    near = lambda c: c.isdigit() or c == "ๆ" or (c.isalpha() and regex.match(r"\p{Latin}", c) is not None)
    for m in _THAI_GAP.finditer(text):
        if _EMPTY_LINE.search(m[0]) or not ((m.start() and near(text[m.start() - 1])) or (m.end() < len(text) and near(text[m.end()]))):
            out.append((at, m.start()))
            at = m.end()
    return [(a, b) for a, b in [*out, (at, len(text))] if a < b]


def _ends(text: str, a: int, b: int, lang: str, last: bool, mono: bool, model: Model) -> list[int]:
    """Places after which a sentence of the paragraph ends."""
    cjk = lang in ("zh", "ja")
    spans = quoted(text, a, b, last)
    ends: list[int] = []
    start = _blank_after(text, a, b)
    at = start

    def big(i: int) -> bool:
        while i < b and (text[i] in OPENERS or text[i].isspace() or text[i] in "…—–-"):
            i += 1
        return i < b and (text[i].isupper() or text[i].istitle())

    while m := _MARK.search(text, at, b):
        mark = m[0]
        if mark[0] in PAIRS and mark not in END:
            close = spans.get(m.start())
            if close is None:
                at = m.end()
                continue
            at = min(close + 1, b)
            if close >= b:
                break
            inner = text[m.start() + 1 : close].rstrip()
            if not inner or inner[-1] not in END and not (inner[-1] in CLOSERS and inner[-2:-1] and inner[-2] in END):
                continue
            end = at
            while end < b and text[end] in CLOSERS and end not in spans:
                end += 1
            then = _blank_after(text, end, b)
            if then >= b:
                break
            opens = m.start() == start or bool((n := _LIST.match(text, start)) and n.end() == m.start())
            c = text[then]
            if c in GOES_ON or c in END:
                continue
            if cjk:
                done = c != "と" if opens else model.starts(text, then, lang)
            elif mono:
                done = model.starts(text, then, lang)
            else:
                done = (big(then) if opens else big(then) and model.starts(text, then, lang)) or bool(_LIST.match(text, then) and model.starts(text, then, lang))
            if done:
                ends.append(end)
                at = start = then
            continue
        end = m.end()
        # the run may go on after a blank (a mark set apart), and closing marks belong to the sentence
        while end < b and text[end] in CLOSERS and end not in spans:
            end += 1
        then = _blank_after(text, end, b)
        at = end
        if then >= b:
            break
        c, apart = text[then], then > end
        dots = set(mark) <= set(".…．") and (len(mark) > 1 or "…" in mark)
        one = mark in (".", "．")
        if c in GOES_ON or c in END:
            continue
        begins = model.starts(text, then, lang)
        if cjk:
            if not dots and not one:
                done = True
            else:
                # a doubled ellipsis is an end mark of its own in these scripts
                done = len(mark) > 1 and dots or begins and (dots or bool(m.start() and _CJK.match(text[m.start() - 1])))
        elif any(c in mark for c in "।॥۔։።"):
            done = True
        elif dots:
            done = begins and (mono or big(then) or bool(_LIST.match(text, then)))
        elif not one:
            if mono:
                done = begins or ("?" in mark and apart)
            else:
                done = (big(then) and (apart or begins)) or (begins and bool(_LIST.match(text, then)))
        else:
            w = _BEFORE.search(text, a, m.start())
            word = w[0].strip(".") if w else ""
            begin = w.start() if w else m.start()
            number = word[:1].isnumeric()
            after = _pair(text, then)[0]
            if number and begin <= start + 1 and len(word) <= 3:
                done = False
            elif (lang, "#" if number else word.casefold(), after) in model.collocations and (after == "#" and not number or not begins):
                done = False
            elif number or model.abbreviates(word, lang) or not apart:
                done = begins and (bool(_LIST.match(text, then)) or not text[then].isnumeric() and (mono or big(then)))
            elif text[then].isnumeric():
                done = begins and bool(_LIST.match(text, then))
            elif mono:
                done = begins or len(word) >= 4
            else:
                done = big(then)
        if done:
            ends.append(end)
            at = start = then
    return ends


def sentences(text: str | None, model: Model) -> list[tuple[int, int]]:
    """(begin, end) of every sentence of a text, in code points."""
    if not text or not text.strip():
        return []
    lang = language(text)
    if lang == "th":
        return _thai(text)
    upper, lower = sum(map(str.isupper, text)), sum(map(str.islower, text))
    mono = not upper or not lower or upper > 4 * lower
    parts = [(a, b) for a, b in paragraphs(text) if text[a:b].strip()]
    out = []
    for k, (a, b) in enumerate(parts):
        cuts = [a, *_ends(text, a, b, lang, k == len(parts) - 1, mono, model), b]
        for x, y in zip(cuts, cuts[1:], strict=False):
            x = _blank_after(text, x, y)
            y = x + len(text[x:y].rstrip())
            if x < y:
                out.append((x, y))
    return out


def sentence_units(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, begin_pos, end_pos) of every sentence; the model is learned from the same documents."""
    own = model or learn(documents, text_col)
    shared = documents.sparkSession.sparkContext.broadcast((own.pairs, own.words, own.abbreviations, own.collocations))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = Model(*shared.value)
        for batch in batches:
            ids, begin, end = [], [], []
            for i, text in enumerate(batch.column(1)):
                for a, b in sentences(text.as_py(), learned):
                    ids.append(i)
                    begin.append(a)
                    end.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "begin_pos", "end_pos"])

    kind = documents.schema[id_col].dataType.simpleString()
    found = documents.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, begin_pos bigint, end_pos bigint")
    # only repeated ids can repeat units: sentences are shuffled where there are any, ids otherwise
    repeated = documents.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    return found.distinct() if repeated else found
