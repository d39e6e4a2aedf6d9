"""Structured Streaming variants of the clip and streak operators.

State is bounded by watermarks: counts of a window go when it ends, and an open streak goes when the
watermark has passed its last clip by more than a clip's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, time: str, window: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """(window start, keys, n, total) of tumbling windows; runs on streams and on tables."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sliding_clip_counts(events: DataFrame, time: str, length: str, advance: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Counts of events per clip of a live axis; clips start at multiples of the advance."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, length, advance).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("clip_start"), F.col("w.end").alias("clip_end"), *keys, "n")


def live_streaks(events: DataFrame, time: str, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Streaks of events per key: runs in which no two neighbours are ``gap`` or more apart."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return out.select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), *keys, "n", "top")


#: State of a series: clips that are not yet part of a closed streak.
STATE = "clips array<struct<idx: bigint, score: double>>"
FOUND = "series string, first_idx bigint, last_idx bigint, score double"


def _merge(known: list[tuple[int, float]], new: list[tuple[int, float]]) -> list[tuple[int, float]]:
    best: dict[int, float] = {}
    for i, s in [*known, *new]:
        best[i] = max(s, best.get(i, s))
    return sorted(best.items())


def _runs(clips: list[tuple[int, float]]) -> list[list[tuple[int, float]]]:
    runs: list[list[tuple[int, float]]] = []
    for c in clips:
        if runs and c[0] == runs[-1][-1][0] + 1:
            runs[-1].append(c)
        else:
            runs.append([c])
    return runs


def index_streaks(scores: DataFrame, clip_seconds: float, late: str = "10 minutes") -> DataFrame:
    """Maximal runs of consecutive clip indices per series, from a stream (series, clip_idx, score, ts).

    ``ts`` is the clip's event time, ``clip_seconds`` the time between neighbouring clips. A run is
    emitted once the watermark shows that no clip next to it can arrive any more.
    """

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = [(c["idx"], c["score"]) for c in state.get[0]] if state.exists else []
        anchor: tuple[int, float] | None = None
        for batch in batches:
            if not len(batch):
                continue
            known = _merge(known, [(int(i), float(s)) for i, s in zip(batch["clip_idx"], batch["score"], strict=True)])
            at = batch["ts"].astype("int64").idxmax()
            anchor = (int(batch.loc[at, "clip_idx"]), batch.loc[at, "ts"].timestamp() * 1000)
        mark = state.getCurrentWatermarkMs()
        runs = _runs(known)
        if state.hasTimedOut:
            closed, still = runs, []
        elif anchor is None:
            closed, still = [], runs
        else:
            safe = anchor[0] + (mark - anchor[1]) / (1000 * clip_seconds)  # clips before this index are complete
            closed = [r for r in runs if r[-1][0] + 1 < safe]
            still = [r for r in runs if r[-1][0] + 1 >= safe]
        left = [{"idx": i, "score": s} for r in still for i, s in r]
        if left:
            state.update((left,))
            if anchor is not None:
                last = anchor[1] + (left[-1]["idx"] - anchor[0] + 2) * 1000 * clip_seconds
                state.setTimeoutTimestamp(int(max(last, mark + 1)))
        elif state.exists:
            state.remove()
        if closed:
            yield pd.DataFrame([(key[0], r[0][0], r[-1][0], max(s for _, s in r)) for r in closed], columns=["series", "first_idx", "last_idx", "score"])

    live = scores.filter("score is not null and series is not null and clip_idx is not null").withWatermark("ts", late)
    return live.groupBy("series").applyInPandasWithState(update, FOUND, STATE, "append", "EventTimeTimeout")
