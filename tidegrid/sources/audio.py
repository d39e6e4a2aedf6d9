"""Decoding of recordings: PCM WAV and AIFF, by their own parsers.

Other containers are read by a decoder that the caller gives (``decoders``: ending to a function from
bytes to (rate, [channel, sample] floats)); without one they give a row with a status. Information (rate, channels, samples) is a projection of
its own, so files are filtered by length before any sample is decoded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INFO = "file string, fs int, n_channels int, n_samples bigint, duration_s double, status string"
SAMPLES = "file string, channel int, fs int, start_sample bigint, samples array<float>, status string"
BLOCKS = "file string, channel int, fs int, start_sample bigint, own_first bigint, own_count bigint, n_samples bigint, samples array<float>, status string"


def _chunks(data: bytes, order: str) -> dict[bytes, tuple[int, int]]:
    at, found = 12, {}
    while at + 8 <= len(data):
        size = struct.unpack_from(order + "I", data, at + 4)[0]
        found.setdefault(data[at : at + 4], (at + 8, size))
        at += 8 + size + (size & 1)
    return found


def _extended(raw: bytes) -> float:
    """80-bit float of an AIFF header."""
    exponent, mantissa = struct.unpack(">HQ", raw)
    return mantissa * 2.0 ** ((exponent & 0x7FFF) - 16383 - 63)


def parse(data: bytes) -> dict:
    """Where the samples of a file are, and how they are stored."""
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        c = _chunks(data, "<")
        at, _ = c[b"fmt "]
        code, channels, fs, _, frame, bits = struct.unpack_from("<HHIIHH", data, at)
        if code == 0xFFFE:
            code = struct.unpack_from("<H", data, at + 24)[0]
        if code not in (1, 3):
            raise ValueError(f"compressed wave format {code}")
        begin, size = c[b"data"]
        size = min(size, len(data) - begin)
        return {"order": "<", "float": code == 3, "bits": bits, "channels": channels, "fs": fs, "begin": begin, "n": size // frame}
    if data[:4] == b"FORM" and data[8:12] in (b"AIFF", b"AIFC"):
        c = _chunks(data, ">")
        at, _ = c[b"COMM"]
        channels, n, bits = struct.unpack_from(">hIh", data, at)
        fs = int(_extended(data[at + 8 : at + 18]))
        kind = data[at + 18 : at + 22] if data[8:12] == b"AIFC" else b"NONE"
        if kind not in (b"NONE", b"sowt", b"fl32"):
            raise ValueError(f"compressed format {kind!r}")
        begin, size = c[b"SSND"]
        offset = struct.unpack_from(">I", data, begin)[0]
        begin += 8 + offset
        return {"order": "<" if kind == b"sowt" else ">", "float": kind == b"fl32", "bits": bits, "channels": channels, "fs": fs, "begin": begin, "n": min(n, (len(data) - begin) // (channels * bits // 8))}
    raise ValueError("unknown container")


def decode(data: bytes, info: dict, first: int = 0, count: int | None = None) -> np.ndarray:
    """Samples [channel, sample] as floats in [-1, 1)."""
    count = max(0, min(info["n"] - first, count if count is not None else info["n"]))
    width = info["bits"] // 8
    raw = data[info["begin"] + first * width * info["channels"] :][: count * width * info["channels"]]
    order = info["order"]
    if info["float"]:
        x = np.frombuffer(raw, f"{order}f{width}").astype(np.float64)
    elif width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128 if order == "<" else np.frombuffer(raw, np.int8) / 128.0
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        b = b if order == "<" else b[:, ::-1]
        v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        x = (v - ((v >> 23) << 24)) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"{order}i{width}") / float(1 << (info["bits"] - 1))
    return x.reshape(-1, info["channels"]).T


def _binary(spark: SparkSession, root: str, glob: str) -> DataFrame:
    from tidegrid.sources.listing import relative_to

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return rows.select(relative_to(F.col("path"), root).alias("file"), "content")


def audio_info(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Rate, channels and length of every file; see INFO."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, data in zip(batch["file"], batch["content"], strict=True):
                try:
                    i = parse(bytes(data))
                    rows.append((file, i["fs"], i["channels"], i["n"], i["n"] / i["fs"], None))
                except Exception as x:
                    rows.append((file, None, None, None, None, f"{type(x).__name__}: {x}"))
            yield pd.DataFrame(rows, columns=["file", "fs", "n_channels", "n_samples", "duration_s", "status"]).astype({"fs": "Int32", "n_channels": "Int32", "n_samples": "Int64"})

    return _binary(spark, root, glob).mapInPandas(run, INFO)


def opened(file: str, data: bytes, decoders: dict | None):
    """(rate, channels, samples, reader of [first, count]) of a file's bytes."""
    own = next((f for ending, f in (decoders or {}).items() if file.lower().endswith(ending.lower())), None)
    if own is not None:
        fs, x = own(data)
        x = np.atleast_2d(np.asarray(x, np.float64))
        return int(fs), x.shape[0], x.shape[1], lambda first, count: x[:, first : first + count]
    info = parse(data)
    return info["fs"], info["channels"], info["n"], lambda first, count: decode(data, info, first, count)


def load_audio(
    spark: SparkSession, root: str, glob: str = "*", channels: list[int] | None = None, offset_s: float = 0.0, duration_s: float | None = None, min_s: float = 0.0,
    max_s: float | None = None, block_s: int | None = None, context_s: int = 0, decoders: dict | None = None,
) -> DataFrame:
    """Samples of every channel; see SAMPLES, or BLOCKS with ``block_s``.

    Files outside [min_s, max_s] give no row. Asked-for channels that a file lacks give a row with a
    status. With ``block_s`` (whole seconds) long files come as several rows, so that no row holds hours
    of sound; each also holds ``context_s`` seconds before and after the block, of which the clips that
    begin in the block (and filters) may need some. Places count from the beginning that ``offset_s``
    leaves, as ``n_samples`` does.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in (BLOCKS if block_s else SAMPLES).split(", ")]
        for batch in batches:
            for file, data in zip(batch["file"], batch["content"], strict=True):
                try:
                    fs, n_channels, n, read = opened(file, bytes(data), decoders)
                    if not min_s <= n / fs <= (max_s if max_s is not None else float("inf")):
                        continue
                    wanted = list(range(n_channels)) if channels is None else channels
                    first = min(n, int(round(offset_s * fs)))
                    count = n - first if duration_s is None else min(n - first, int(round(duration_s * fs)))
                    step, context = (block_s * fs, context_s * fs) if block_s else (max(1, count), 0)
                    for at in range(0, count, step):
                        low, high = max(0, at - context), min(count, at + step + context)
                        x = read(first + low, high - low).astype(np.float32)
                        place = (low, at, min(step, count - at), count) if block_s else (first,)
                        yield pd.DataFrame([(file, c, fs, *place, x[c] if c < len(x) else None, None if c < len(x) else "no such channel") for c in wanted], columns=names)
                except Exception as x:
                    yield pd.DataFrame([(file, *[None] * (len(names) - 2), f"{type(x).__name__}: {x}")], columns=names)

    return _binary(spark, root, glob).mapInPandas(run, BLOCKS if block_s else SAMPLES)


def write_wav(path: str, x: np.ndarray, fs: int) -> None:
    """16-bit PCM wave file of [channel, sample] floats."""
    pcm = np.trunc(np.clip(np.atleast_2d(x) * 32768, -32768, 32767)).astype("<i2")
    body = pcm.T.tobytes()
    channels = pcm.shape[0]
    head = b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, fs, fs * channels * 2, channels * 2, 16) + b"data" + struct.pack("<I", len(body))
    with open(path, "wb") as f:
        f.write(head + body)
