"""Mapping of free-entered values to a canonical list.

Each distinct token of the values is joined to the tokens of the reference list: by edit distance
(deletion neighbourhoods, or unchanged segments for long tokens, make that an equi-join; a
transposition-aware distance decides) and as an abbreviation by its prefixes. Corrected tokens are
combined with soft TF-IDF: an entry is meant if all its tokens are found, and entries are ranked by
the edits they need and then by their soft TF-IDF sum. Only distinct values and distinct tokens take
part, so frequent values cost one row; the result is joined back with salted keys.

Words of any script are tokens. Letters that look like Latin ones are read as these where that makes
the whole word Latin, on both sides alike.

Defined results: null and blank values, and values that are letter for letter a label, give no
row. A value that fits entries of different classes alike, that fits none, or that is an alias
whose target is no label, gives -1. Repeated rows give one row. Entries with null fields are
ignored. An empty reference list maps everything to -1. Values without letters and digits fit none.
"""

from __future__ import annotations

import itertools
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.store import broadcast_if_small, durable

#: Largest number of edits by token length; tokens with digits are codes and must be right.
EDITS = ((3, 0),)
MAX_EDITS = 2
#: Edits (an abbreviation counts half) that a whole value may need.
MAX_COST = 3
#: Letters of a reference token from which segments are looked up instead of deletions.
LONG_TOKEN = 16
#: Two edits (swaps included) touch at most four neighbouring segments of a token.
SEGMENTS = 2 * MAX_EDITS + 1
SALT = 16

#: Letters of other scripts that look like Latin ones, with the Latin letter.
LOOKALIKES = str.maketrans("авекмнорстухіјѕԁһԛԝґєӏαβεικνορτυχ", "abekmhopctyxijsdhqwrelabeiknoptux")

#: Letters that have no decomposition, with their plain spelling.
PLAIN = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i", "ħ": "h"})

_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_LATIN = regex.compile(r"[\p{Latin}\p{N}]+")


def normal_tokens(value: str) -> list[str]:
    """Words of a value in lower case without accents; Latin lookalikes of other scripts as Latin."""
    plain = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", value).casefold())
    plain = "".join(c for c in plain if not unicodedata.combining(c)).translate(PLAIN)
    words = _WORDS.findall(unicodedata.normalize("NFC", plain))
    return [latin if _LATIN.fullmatch(latin := w.translate(LOOKALIKES)) else w for w in words]


def edit_distance(a: str, b: str, most: int = MAX_EDITS) -> int:
    """Damerau-Levenshtein distance (letters may be edited between swapped ones); at most ``most + 1``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    last_row: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        last_column = 0
        for j, y in enumerate(b, 1):
            i1, j1 = last_row.get(y, 0), last_column
            if x == y:
                last_column = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[i1][j1] + (i - i1 - 1) + 1 + (j - j1 - 1))
        last_row[x] = i
    return min(d[-1][-1], most + 1)


def allowed_edits(token: str) -> int:
    """Edits a reference token may be away from what was typed."""
    if any(c.isdigit() for c in token):
        return 0
    return next((n for length, n in EDITS if len(token) <= length), MAX_EDITS)


def deletions(token: str, n: int) -> set[str]:
    """The token with up to ``n`` characters left out."""
    found = level = {token}
    for _ in range(n):
        level = {t[:i] + t[i + 1 :] for t in level for i in range(len(t))}
        found = found | level
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens(values: pd.Series) -> pd.Series:
    return values.map(normal_tokens)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _joined_tokens(values: pd.Series) -> pd.Series:
    """What a tag offers besides its words: neighbours written apart, and all of it as one word."""

    def joins(tokens: list[str]) -> list[str]:
        pairs = {a + b for a, b in itertools.pairwise(tokens)}
        return sorted((pairs | {"".join(tokens)}) - set(tokens) - {""})

    return values.map(lambda t: joins(list(t)))


def segments(token: str) -> list[tuple[int, str]]:
    """A long token in ``SEGMENTS`` parts: (first letter's place, part)."""
    at = [len(token) * k // SEGMENTS for k in range(SEGMENTS + 1)]
    return [(a, token[a:b]) for a, b in itertools.pairwise(at)]


def known_keys(token: str) -> set[str]:
    """Keys under which a reference token is found by whatever is within its edits."""
    n = allowed_edits(token)
    if n and len(token) >= LONG_TOKEN:
        return {f"{len(token)}:{k}:{part}" for k, (_, part) in enumerate(segments(token))}
    return deletions(token, n)


def typed_keys(token: str) -> set[str]:
    """Keys of a typed token: its deletions, and parts where a long token of near length may have them."""
    if any(c.isdigit() for c in token):
        return {token}
    found: set[str] = set()
    if len(token) < LONG_TOKEN + MAX_EDITS:
        found = deletions(token, MAX_EDITS)
    for n in range(max(LONG_TOKEN, len(token) - MAX_EDITS), len(token) + MAX_EDITS + 1):
        for k, (at, part) in enumerate(segments("x" * n)):
            places = range(max(0, at - MAX_EDITS), at + MAX_EDITS + 1)
            found.update(f"{n}:{k}:{token[i : i + len(part)]}" for i in places if i + len(part) <= len(token))
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def _typed_keys(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: sorted(typed_keys(t)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _known_keys(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: sorted(known_keys(t)))


@F.pandas_udf(T.IntegerType())
def _distance(typed: pd.Series, known: pd.Series) -> pd.Series:
    return pd.Series([d if (d := edit_distance(a, b)) <= allowed_edits(b) else None for a, b in zip(typed, known, strict=True)], dtype="Int32")


def reference_entries(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entry, variant, target, tokens) of labels and aliases; ``target`` is -1 for aliases of nothing.

    ``labels`` has (name, target), ``aliases`` (name, dst). Each entry also comes written as one word,
    in either order of its words.
    """
    dst = labels.select(F.col("name").alias("dst"), F.col("target").alias("t")).dropna().groupBy("dst").agg(F.min("t").alias("t"))
    named = labels.select("name", "target").dropna()
    through = aliases.select("name", "dst").filter("name is not null").join(broadcast_if_small(dst), "dst", "left").select("name", F.coalesce("t", F.lit(-1)).cast(named.schema["target"].dataType).alias("target"))
    entries = named.union(through).distinct().select(F.concat_ws("\1", "name", F.col("target").cast("string")).alias("entry"), "target", _tokens("name").alias("tokens")).filter("size(tokens) > 0")
    one_word = lambda t: F.array(F.concat_ws("", t))
    variants = F.array(F.struct(F.lit("words").alias("v"), F.col("tokens").alias("t")), F.struct(F.lit("joined").alias("v"), one_word(F.col("tokens")).alias("t")), F.struct(F.lit("swapped").alias("v"), one_word(F.reverse("tokens")).alias("t")))
    return entries.select("entry", "target", F.explode(variants).alias("x")).select("entry", "target", F.col("x.v").alias("variant"), F.array_distinct("x.t").alias("tokens"))


def token_repairs(typed: DataFrame, known: DataFrame) -> DataFrame:
    """(token, known, edits, abbreviated) of distinct ``typed`` (token, whole) and ``known`` (known)."""
    spark = typed.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # few bytes but much work a row: explicit partitions keep all cores busy
    a = typed.select("token").repartition(n, "token").select("token", F.explode(_typed_keys("token")).alias("d"))
    b = known.select("known", F.explode(_known_keys("known")).alias("d"))
    # the plain distance bounds the one with swaps on both sides, which decides the rest
    pairs = a.join(broadcast_if_small(b), "d").select("token", "known").distinct().repartition(n, "token", "known")
    pairs = pairs.withColumn("plain", F.levenshtein("token", "known", 2 * MAX_EDITS)).filter("plain >= 0")
    near = pairs.filter("plain <= 1").select("token", "known", F.when((F.col("plain") == 0) | ~F.col("known").rlike(r"\p{N}") & (F.length("known") > EDITS[0][0]), F.col("plain")).alias("edits"))
    near = near.union(pairs.filter("plain > 1").select("token", "known", _distance("token", "known"))).filter("edits is not null")
    prefixes = known.filter(r"known rlike '^\\p{L}+$'").select("known", F.explode(F.expr("transform(sequence(1, length(known)), i -> substr(known, 1, i))")).alias("token")).filter("token <> known")
    short = typed.filter("whole").join(broadcast_if_small(prefixes), "token").select("token", "known", F.lit(0).alias("edits"))
    return near.withColumn("abbreviated", F.lit(0)).union(short.withColumn("abbreviated", F.lit(1)))


def meant_entries(values: DataFrame, labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """(value, target) of every distinct ``value``: the target of the entry meant, or -1."""
    entries = durable(reference_entries(labels, aliases), "entries")
    postings = entries.select("entry", "variant", "target", F.size("tokens").alias("n"), F.explode("tokens").alias("known"))
    frequency = postings.groupBy("known").agg(F.countDistinct("entry").alias("df"))
    total = entries.agg(F.greatest(F.countDistinct("entry"), F.lit(1)).alias("entries"))
    weighted = postings.join(broadcast_if_small(frequency), "known").join(F.broadcast(total)).withColumn("idf", F.log(1 + F.col("entries") / F.col("df"))).drop("entries", "df")  # one row
    parts = values.select("value", _tokens("value").alias("tokens"))
    parts = parts.select("value", F.explode(F.concat(F.transform("tokens", lambda t: F.struct(t.alias("token"), F.lit(True).alias("whole"))), F.transform(_joined_tokens("tokens"), lambda t: F.struct(t.alias("token"), F.lit(False).alias("whole"))))).alias("p"))
    parts = durable(parts.select("value", "p.token", "p.whole").distinct(), "parts")
    typed = parts.groupBy("token").agg(F.max("whole").alias("whole"))
    repairs = durable(token_repairs(typed, postings.select("known").distinct()), "repairs")
    similarity = 1 - 0.2 * F.col("edits") - 0.3 * F.col("abbreviated")
    hits = repairs.join(broadcast_if_small(weighted), "known").select("token", "entry", "variant", "target", "n", "known", "idf", "edits", "abbreviated", similarity.alias("sim"))
    fit = parts.join(broadcast_if_small(hits), "token").filter("whole or abbreviated = 0")
    # the best token of the value for each token of the entry
    best = fit.groupBy("value", "entry", "variant", "target", "n", "known").agg(F.min(F.struct((F.col("edits") + F.col("abbreviated") * 0.5).alias("cost"), (-F.col("sim")).alias("s"), "abbreviated", "token", "idf")).alias("b"))
    scored = best.groupBy("value", "entry", "variant", "target", "n").agg(
        F.count("*").alias("found"),
        F.sum("b.abbreviated").alias("short"),
        F.sum("b.cost").alias("cost"),
        F.countDistinct("b.token").alias("used"),
        F.sum(-F.col("b.s") * F.col("b.idf") * F.col("b.idf")).alias("soft"),
    )
    whole = scored.filter(f"found = n and used = n and short < n and cost <= {MAX_COST}")
    top = whole.groupBy("value", "target").agg(F.min(F.struct("cost", (-F.col("soft")).alias("rank"))).alias("r"))
    # entries alike: same cost; of those the target with the clearly larger soft TF-IDF sum
    least = top.groupBy("value").agg(F.min("r").alias("least"))
    alike = top.join(least, "value").filter("r.cost <= least.cost + 1e-9 and r.rank <= least.rank + 1e-6")
    chosen = alike.groupBy("value").agg(F.count("*").alias("n"), F.min("target").alias("target"))
    return chosen.select("value", F.when(F.col("n") == 1, F.col("target")).otherwise(-1).alias("target"))


def map_tags(selections: DataFrame, classes: DataFrame, remap: DataFrame) -> DataFrame:
    """(sel_id, class_idx) of every selection whose tags are not blank and not exactly a label."""
    labels = classes.select(F.col("label").alias("name"), F.col("class_idx").cast("bigint").alias("target"))
    exact = broadcast_if_small(labels.select(F.col("name").alias("tags")).dropna().distinct())
    rows = selections.select(F.col("sel_id").cast("bigint").alias("sel_id"), "tags").filter(F.regexp_replace("tags", r"[\s\p{Z}\p{C}]+", "") != "").join(exact, "tags", "left_anti")
    rows = rows.distinct()
    meant = meant_entries(rows.select(F.col("tags").alias("value")).distinct(), labels, remap.select(F.col("src").alias("name"), "dst"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("sel_id"), F.lit(SALT)))
    found = meant.select(F.col("value").alias("tags"), F.col("target").alias("class_idx"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))).alias("salt"))
    out = salted.join(found, ["tags", "salt"], "left").groupBy("sel_id", "tags").agg(F.coalesce(F.max("class_idx"), F.lit(-1)).alias("class_idx"))
    return out.groupBy("sel_id").agg(F.max("class_idx").alias("class_idx"))
