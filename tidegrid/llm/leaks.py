"""Evaluation texts that leak into training texts, by size-partitioned MinHash containment search.

Queries are the passages of the items: every run of ``WORDS`` words (``CHARS`` characters in
scripts without blanks). A text is cut into overlapping blocks such that each such run lies wholly
in one block. Of a block only the shingles that occur in some item matter: leaving the others out
changes no containment, and a block with fewer of them than a passage keeps is passed over. Blocks
are partitioned by the number of shingles that are left. For the upper size ``x`` of a partition, containment ``t`` of a query of ``q`` shingles means a Jaccard similarity of at
least ``t q / (x + q - t q)``, which fixes how many minima the partition compares so that a passage
is missed with probability ``MISS`` at most. Candidates are verified exactly: words of text and
item are matched on their diagonals, and a single misspelt word between right ones does not break
a run: one slip, or two in a word of ``LONG`` letters, where ß and ligatures count as one letter or
as those they stand for, whichever makes fewer slips.

Words are compared in folded form: compatibility-normalised, without case, accents, apostrophes,
hyphens (and the line breaks after them) and other marks.

Defined results: null, empty and too short texts hold nothing; items shorter than a passage are
held by no text; each (text, item) comes once; a text may hold several items. The items are the
query side: they are read in blocks of ``ITEM_BLOCK`` rows, and every text is searched with every
block.
"""

from __future__ import annotations

import functools
import math
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS, CHARS = 13, 25
#: Letters of a word that may have two slips.
LONG = 8
#: Containment that a passage keeps at least, however many of its words are misspelt: with every second
#: one, 6 of 23 shingles are left (12 of 47 for characters).
CONTAINMENT = 0.255
PERMUTATIONS, MISS = 96, 1e-4
#: Items searched at a time.
ITEM_BLOCK = 20_000
SIZES = (16, 32, 48, 96)

_JOINED = regex.compile(r"(?<=[\p{L}\p{M}])[-‐‑­]\s*\n\s*(?=\p{L})|[­​-‍⁠﻿]|(?<=[\p{L}\p{M}])['’ʼ‘`´\-‐‑](?=\p{L})")
_TOKEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]|[[\p{L}\p{M}\p{N}]--[\p{Han}\p{Hiragana}\p{Katakana}ー]]+", regex.V1)
_CHAR = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")
_ACCENT = regex.compile(r"[̀-ͯ]")


#: Letters that folding expands, each kept as one letter of a script that texts do not use (Linear A).
_EXPANDED = {chr(0x10600 + k): v for k, v in enumerate(("ss", "ff", "fi", "fl", "ffi", "ffl", "st", "ij"))}
_KEPT = str.maketrans({c: chr(0x10600 + k) for k, cs in enumerate(("ßẞ", "ﬀ", "ﬁ", "ﬂ", "ﬃ", "ﬄ", "ﬅﬆ", "ĳĲ")) for c in cs})
_EXPAND = str.maketrans(_EXPANDED)


def expanded(tokens: list[str]) -> list[str]:
    """Tokens of ``folded_tokens`` as they are compared."""
    return "\n".join(tokens).translate(_EXPAND).split("\n") if any(c in "\n".join(tokens) for c in _EXPANDED) else tokens


def folded_tokens(text: str) -> list[str]:
    """Words of a text, and single characters of scripts without blanks, in folded form but for letters to expand."""
    plain = unicodedata.normalize("NFKC", text.translate(_KEPT))
    plain = _JOINED.sub("", plain).casefold()
    plain = unicodedata.normalize("NFC", _ACCENT.sub("", unicodedata.normalize("NFD", plain)))
    return _TOKEN.findall(plain)


def passage_length(lang: str | None, tokens: list[str]) -> int:
    """Tokens that make a passage: characters where most tokens are characters."""
    single = sum(1 for t in tokens if _CHAR.match(t))
    return CHARS if lang in ("zh", "ja") or 2 * single > len(tokens) else WORDS


def shingles(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of neighbouring token pairs, and of pairs with one token between them."""
    h = np.fromiter((zlib.crc32(t.encode()) for t in tokens), np.uint64, len(tokens))
    with np.errstate(over="ignore"):
        x = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        y = h[:-2] * np.uint64(0xD6E8FEB86659FD93) + h[2:] * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(31)), y ^ (y >> np.uint64(31))


@functools.cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    return rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def permuted(x: np.ndarray) -> np.ndarray:
    """Values of all shingles under all permutations, 32 bits each."""
    a, b = _permutations()
    with np.errstate(over="ignore"):
        return (x[:, None] * a + b) >> np.uint64(32)


@functools.cache
def minima_needed(size: int, query: int, containment: float = CONTAINMENT) -> int:
    """Minima to compare in a partition of blocks with up to ``size`` shingles."""
    held = containment * query
    similarity = held / (size + query - held)
    return min(PERMUTATIONS, math.ceil(math.log(MISS) / math.log(1 - similarity)))


def ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [low, high), one after another."""
    n = high - low
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


class ItemIndex:
    """Minima of all passages of the items, sorted for lookup, and the items' tokens."""

    def __init__(self, rows: list[tuple[int, str, str | None]]):
        self.items: dict[int, tuple[list[str], int, dict[str, list[int]]]] = {}
        self.kinds: set[tuple[int, int]] = set()  # length and number of single characters of all passages
        keys, owners, known = [], [], [np.empty(0, np.uint64)]
        for item_id, text, lang in rows:
            kept = folded_tokens(text or "")
            tokens = expanded(kept)
            n = passage_length(lang, tokens)
            if len(tokens) < n:
                continue
            places = defaultdict(list)
            for i, t in enumerate(tokens):
                places[t].append(i)
            self.items[item_id] = (kept, n, dict(places))
            single = np.cumsum([0, *(bool(_CHAR.match(t)) for t in tokens)])
            self.kinds.update((n, c) for c in np.unique(single[n:] - single[:-n]).tolist())
            own = shingles(tokens)
            known += own
            near, apart = map(permuted, own)
            windows = np.minimum(*(np.lib.stride_tricks.sliding_window_view(v, w, axis=0).min(2) for v, w in ((near, n - 1), (apart, n - 2))))
            key = np.unique((windows << np.uint64(8)) | np.arange(PERMUTATIONS, dtype=np.uint64))
            keys.append(key)
            owners.append(np.full(len(key), item_id, np.int64))
        key, owner = (np.concatenate(keys), np.concatenate(owners)) if keys else (np.empty(0, np.uint64), np.empty(0, np.int64))
        order = np.argsort(key, kind="stable")
        self.key, self.owner = key[order], owner[order]
        self.known = np.unique(np.concatenate(known))  # shingles of all items
        self.words: dict[str, int] = {}
        self.numbers = {i: np.array([self.words.setdefault(t, len(self.words)) for t in expanded(kept)], np.int64) for i, (kept, _, _) in self.items.items()}

    def occurs(self, x: np.ndarray) -> np.ndarray:
        """Which shingles occur in some item?"""
        return self.known[np.minimum(np.searchsorted(self.known, x), len(self.known) - 1)] == x

    def candidates(self, tokens: list[str], plain: list[str]) -> set[int]:
        """Items of which some passage may be contained in some block of the text.

        ``plain`` is ``expanded(tokens)``.
        """
        if len(tokens) < WORDS or not len(self.key):
            return set()
        x, apart = shingles(plain)
        near_known, apart_known = self.occurs(x), np.append(self.occurs(apart), False)
        count = near_known.astype(np.int64) + apart_known
        found: set[int] = set()
        single, values = None, None
        for n in sorted({n for n, _ in self.kinds}):
            step, least = n - 1, math.ceil(CONTAINMENT * (2 * n - 3))
            if len(tokens) < n or count.sum() < least:
                continue
            # blocks of two steps: every run of n tokens lies in one of them
            at = np.arange(0, len(x), step)
            sizes = np.add.reduceat(count, at)
            sizes = sizes[:-1] + sizes[1:] if len(sizes) > 1 else sizes
            if sizes.max() < least:
                continue
            if single is None:
                single = sum(1 for t in tokens if _CHAR.match(t))
            if not any((single or not c) and (single < len(tokens) or c == n) for k, c in self.kinds if k == n):
                continue
            if values is None:
                values = np.full((len(x), PERMUTATIONS), np.iinfo(np.uint64).max)
                values[near_known] = permuted(x[near_known])
                values[apart_known] = np.minimum(values[apart_known], permuted(apart[apart_known[:-1]]))
            lows = np.minimum.reduceat(values, at, axis=0)
            lows = np.minimum(lows[:-1], lows[1:]) if len(lows) > 1 else lows
            below = least - 1
            for upper in SIZES:
                m = minima_needed(upper, 2 * n - 3)
                some = (sizes <= upper) & (sizes > below)
                below = max(below, upper)
                if not some.any():
                    continue
                own = lows[some][:, :m]
                probe = np.unique((own << np.uint64(8)) | np.arange(m, dtype=np.uint64))
                found.update(np.unique(self.owner[ranges(np.searchsorted(self.key, probe, "left"), np.searchsorted(self.key, probe, "right"))]).tolist())
        return found

    def aligned(self, plain: list[str], items: set[int]) -> list[int]:
        """Those of the items that share words with the text on one diagonal, over a passage, with single ones between wrong."""
        if not items:
            return []
        own = sorted(items)
        lengths = [len(self.numbers[i]) for i in own]
        number = np.concatenate([self.numbers[i] for i in own])
        item, place = np.repeat(np.arange(len(own)), lengths), np.concatenate([np.arange(n) for n in lengths])
        order = np.argsort(number, kind="stable")
        number, item, place = number[order], item[order], place[order]
        text = np.fromiter((self.words.get(t, -1) for t in plain), np.int64, len(plain))
        low, high = np.searchsorted(number, text, "left"), np.searchsorted(number, text, "right")
        at = ranges(low, high)
        span = len(plain) + max(lengths)
        i = np.repeat(np.arange(len(text)), high - low)
        key = (item[at] * span + i - place[at] + max(lengths)) * (2 * span) + i
        key.sort()
        if not len(key):
            return []
        first = np.flatnonzero(np.r_[True, np.diff(key) > 2])
        last = np.r_[first[1:], len(key)] - 1
        which = key[first] // (2 * span * span)
        passage = np.array([self.items[k][1] for k in own])
        return [own[k] for k in np.unique(which[key[last] - key[first] + 1 >= passage[which]])]

    def holds(self, tokens: list[str], plain: list[str], item_id: int) -> bool:
        """Does the text hold a passage of the item?"""
        item, n, places = self.items[item_id]
        runs: dict[int, tuple[int, int]] = {}  # diagonal to (first, last) place in the text
        for i, t in enumerate(plain):
            for p in places.get(t, ()):
                d = i - p
                first, last = runs.get(d, (i, -9))
                if last == i - 1 or last == i - 2 and misspelt(tokens[i - 1], item[p - 1]):
                    if i - first + 1 >= n:
                        return True
                    runs[d] = (first, i)
                else:
                    runs[d] = (i, i)
        return False


def misspelt(a: str, b: str) -> bool:
    """Could one word be written for the other by one slip, or by two if both are long."""
    if len(a) == 1 and len(b) == 1:
        return True
    whole = tuple(expanded([a, b]))
    most = 2 if min(map(len, whole)) >= LONG else 1
    if slips(*whole, most) <= most:
        return True
    short = whole
    for letter in sorted(set(a + b) & _EXPANDED.keys(), key=lambda c: -len(_EXPANDED[c])):
        short = tuple(w.replace(_EXPANDED[letter], letter) for w in short)
    return short != whole and slips(*short, most) <= most


def slips(a: str, b: str, most: int) -> int:
    """Letters wrong, missing, too many or swapped between two words, or more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    older, old = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(old[j] + 1, new[j - 1] + 1, old[j - 1] + (x != y))
            if older is not None and j > 1 and x == b[j - 2] and y == a[i - 2]:
                cost = min(cost, older[j - 2] + 1)
            new.append(cost)
        if min(new) > most + 1:
            return most + 1
        older, old = old, new
    return old[-1]


def _search(documents: DataFrame, rows: list) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"], r["lang"]) for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(shared.value)
        for batch in batches:
            docs, items = [], []
            for i, text in enumerate(batch.column(1)):
                if not (value := text.as_py()):
                    continue
                tokens = folded_tokens(value)
                plain = expanded(tokens)
                for item in index.aligned(plain, index.candidates(tokens, plain)):
                    if index.holds(tokens, plain, item):
                        docs.append(i)
                        items.append(item)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs, pa.int64())), pa.array(items, pa.int64())], names=["doc_id", "item_id"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.mapInArrow(run, f"doc_id {kind}, item_id bigint")


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every text that holds a passage of an item."""
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text", "lang").filter("item_id is not null and text is not null")
    texts = documents.select("doc_id", "text")
    blocks = max(1, math.ceil(items.count() / ITEM_BLOCK))
    found = None
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).limit(2 * ITEM_BLOCK + 1).collect()
        if len(own) > 2 * ITEM_BLOCK:
            raise ValueError("one item_id has too many rows")
        part = _search(texts, own)
        found = part if found is None else found.union(part)
    return found.distinct()


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Items that leaked, with the number of texts that hold them."""
    return leaked_items(documents, items).groupBy("item_id").agg(F.count("*").alias("n_docs"))
