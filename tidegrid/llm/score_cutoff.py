"""Cutoff keeping a target fraction of each source, by multi-sequence selection.

Every partition keeps its scores as sorted arrays, one per source and Arrow batch, written once to the
shared folder.
A round takes evenly spaced elements of each array's active range as pivots, has every array rank
them with ``searchsorted``, adds the ranks up, and narrows the active range of every source at once;
it ends when the wanted rank falls on a pivot. One source may hold any share of the rows: its
arrays stay where they were cut, and only pivots and ranks move (beyond ``SOURCES_BROADCAST`` sources
arrays meet their source's pivots by a shuffle).

Defined results: a repeated id counts once, rows with a null id and null and NaN scores not at all, sources without a
target (or with a null one) and sources without a score give no row. Ties at the cutoff are all
kept. Targets above 100 keep everything, targets below or at 0 give no row. Of several target rows
of one source the largest counts. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.store import broadcast_if_small, drop, durable, write_table

#: Pivots taken from each source in a round, and from each array.
PIVOTS, LOCAL_PIVOTS = 64, 32
SOURCES_BROADCAST = 20_000


def _sort_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rows, sorted by source, to one sorted array per source (two where a batch ends)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(0).dictionary_encode()
        code, value = codes.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        order = np.lexsort((value, code))
        offsets = np.r_[0, np.cumsum(np.bincount(code, minlength=len(codes.dictionary)))].astype(np.int32)
        yield pa.RecordBatch.from_arrays([codes.dictionary, pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[order]))], names=["source", "vals"])


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _local_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, vals, lo, hi) to evenly spaced elements of the active range."""
    for batch in batches:
        source, pivot = [], []
        los, his = batch.column("lo").to_numpy(zero_copy_only=False), batch.column("hi").to_numpy(zero_copy_only=False)
        for i, vals in enumerate(_lists(batch.column("vals"))):
            a, b = np.searchsorted(vals, los[i], "left"), np.searchsorted(vals, his[i], "right")
            if a < b:
                at = np.unique(np.linspace(a, b - 1, min(LOCAL_PIVOTS, b - a)).astype(np.int64))
                source += [i] * len(at)
                pivot.append(vals[at])
        columns = [batch.column("source").take(pa.array(source, pa.int64())), pa.array(np.concatenate(pivot) if pivot else [], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["source", "pivot"])


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, vals, pivots) to how many elements are at or above, and above, each pivot."""
    for batch in batches:
        source, pivot, at_least, above = [], [], [], []
        for i, (vals, own) in enumerate(zip(_lists(batch.column("vals")), _lists(batch.column("pivots")), strict=True)):
            source += [i] * len(own)
            pivot.append(own)
            at_least.append(len(vals) - np.searchsorted(vals, own, "left"))
            above.append(len(vals) - np.searchsorted(vals, own, "right"))
        join = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("source").take(pa.array(source, pa.int64())), join(pivot), join(at_least), join(above)], names=["source", "pivot", "at_least", "above"])


def _beside(arrays: DataFrame, state: DataFrame) -> DataFrame:
    """Arrays with their source's state; the state travels, the arrays stay."""
    return arrays.join(broadcast_if_small(state, SOURCES_BROADCAST), "source")


def cutoffs(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, cutoff, n_kept) for ``values`` (source, value bigint) and ``wanted`` (source, pct)."""
    spark = values.sparkSession
    wanted = wanted.filter("source is not null and pct > 0").groupBy("source").agg(F.least(F.max("pct"), F.lit(100)).cast("bigint").alias("pct"))
    arrays, arrays_path = write_table(values.dropna().sortWithinPartitions("source", "value").mapInArrow(_sort_arrays, "source string, vals array<bigint>"), "sorted")
    sizes = arrays.groupBy("source").agg(F.sum(F.size("vals")).cast("bigint").alias("n"), F.min(F.element_at("vals", 1)).alias("lo"), F.max(F.element_at("vals", -1)).alias("hi"))
    state, state_path = write_table(
        sizes.join(wanted, "source").select("source", F.expr("(n * pct + 99) div 100").alias("k"), "lo", "hi", F.lit(None).cast("bigint").alias("cutoff"), F.lit(None).cast("bigint").alias("n_kept")), "state"
    )
    while state.filter("cutoff is null").limit(1).count():
        active = state.filter("cutoff is null")
        local = _beside(arrays, active.select("source", "lo", "hi")).mapInArrow(_local_pivots, "source string, pivot bigint")
        # a quantile sketch of the local pivots picks the round's pivots; exact ranks follow
        shares = F.array(*[F.lit(i / (PIVOTS - 1)) for i in range(PIVOTS)])
        picked = local.groupBy("source").agg(F.array_sort(F.array_distinct(F.percentile_approx("pivot", shares, F.lit(1000)))).alias("pivots"))
        picked = durable(picked, "pivots")
        ranked = _beside(arrays, picked).select("source", "vals", "pivots").mapInArrow(_ranks, "source string, pivot bigint, at_least bigint, above bigint")
        ranked = ranked.groupBy("source", "pivot").agg(F.sum("at_least").alias("at_least"), F.sum("above").alias("above"))
        judged = ranked.join(active.select("source", "k"), "source")
        hit = (F.col("at_least") >= F.col("k")) & (F.col("above") < F.col("k"))
        narrowed = judged.groupBy("source").agg(
            F.max(F.when(hit, F.col("pivot"))).alias("found"),
            F.max(F.when(hit, F.col("at_least"))).alias("kept"),
            F.max(F.when(F.col("above") >= F.col("k"), F.col("pivot") + 1)).alias("new_lo"),
            F.min(F.when(F.col("at_least") < F.col("k"), F.col("pivot") - 1)).alias("new_hi"),
        )
        state_next = state.join(narrowed, "source", "left").select(
            "source", "k", F.greatest("lo", F.coalesce("new_lo", "lo")).alias("lo"), F.least("hi", F.coalesce("new_hi", "hi")).alias("hi"), F.coalesce("cutoff", "found").alias("cutoff"), F.coalesce("n_kept", "kept").alias("n_kept")
        )
        state, new_path = write_table(state_next, "state")
        drop(spark, state_path)
        state_path = new_path
    drop(spark, arrays_path)
    return state.select("source", "cutoff", "n_kept")


def source_cutoffs(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """(deployment, cutoff_e6, n_kept) of every deployment with a target and a score.

    Scores have at most six decimals and are compared in millionths.
    """
    e6 = F.rint(F.col("score") * 1e6).cast("bigint")
    live = scores.filter(F.col("score_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & F.col("deployment").isNotNull())
    once = live.groupBy("score_id").agg(F.min(F.struct(F.col("deployment").alias("source"), e6.alias("value"))).alias("s")).select("s.source", "s.value")
    found = cutoffs(once, targets.select(F.col("deployment").alias("source"), F.col("keep_pct").alias("pct")))
    return found.select(F.col("source").alias("deployment"), F.col("cutoff").alias("cutoff_e6"), "n_kept")
