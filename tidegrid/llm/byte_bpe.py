"""Encoding of a corpus with a public byte-level BPE tokenizer.

Texts are cut by the tokenizer's pattern; each piece is merged with a segment tree over its byte
positions. A leaf holds the rank of the pair that starts there and an inner node the leftmost
minimum of its range, so the root names the next merge, and a merge is three point updates of
logarithmic cost: the merged position, its dead neighbour and the live position before it. Very
long pieces therefore cost n log n. Pieces seen before come from a bounded memo of each worker.

Defined results: null and empty texts encode to an empty list; every row of the input gives a row.
Special tokens are never produced: their strings in a text are ordinary text. Lone surrogates
cannot occur in Spark strings. The vocabulary file is read by the driver (its path is a parameter)
and broadcast; its size is fixed by the tokenizer.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenization pattern that belongs to the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces a worker remembers, and their longest length in bytes.
MEMO, MEMO_BYTES = 100_000, 64

_NONE = 1 << 60


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens with their ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    n = len(piece)
    if n == 1 or piece in ranks:
        return [ranks[piece]]
    width = 1 << (n - 1).bit_length()
    shift = width.bit_length()
    mask = (1 << shift) - 1
    parts: list[bytes] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [_NONE] * (2 * width)
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = rank << shift | i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    while (top := tree[1]) != _NONE:
        i = top & mask
        j = after[i]
        parts[i] += parts[j]
        k = after[j]
        after[i] = k
        put(j, _NONE)
        if k < n:
            before[k] = i
            rank = get(parts[i] + parts[k])
            put(i, _NONE if rank is None else rank << shift | i)
        else:
            put(i, _NONE)
        h = before[i]
        if h >= 0:
            rank = get(parts[h] + parts[i])
            put(h, _NONE if rank is None else rank << shift | h)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[parts[i]])
        i = after[i]
    return ids


class Encoder:
    """Texts to token ids, with a bounded memo of pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.memo, self.cut = ranks, {}, regex.compile(PATTERN)

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        memo = self.memo
        for piece in self.cut.findall(text or ""):
            own = memo.get(piece)
            if own is None:
                raw = piece.encode()
                own = merge_piece(raw, self.ranks)
                if len(raw) <= MEMO_BYTES:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = own
            ids += own
        return ids


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row; no shuffle, only the two columns are read."""
    shared = documents.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            # a few texts at a time, so that very long ones do not pile up
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                flat, offsets = array("q"), array("i", [0])
                for text in part.column(1):
                    flat.extend(encoder.encode(text.as_py()))
                    offsets.append(len(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))], names=["doc_id", "ids"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<bigint>")
