"""Continuous periods and gaps from overlapping intervals, by run bitmaps per time shard.

Every exact time unit ``t`` owns cell ``2t`` and the open stretch to ``t + 1`` owns cell
``2t + 1``, so the closed interval ``[b, e]`` sets cells ``2b .. 2e``. Intervals that overlap or
touch share a cell, a moment without length sets one cell, and two intervals one unit apart leave
a clear cell between them. The cell axis is cut into shards of ``2**SHARD_BITS`` cells. A shard's
bitmap is kept run-compressed (two sorted lists, first and last cell of each run), so it never has
more than half as many runs as cells, whatever number of rows fell into it.

Plan: rows are compressed to run bitmaps on the map side (NumPy, ``COMPRESS_ROWS`` rows at a time), one
shuffle by (entity, shard) unions them, and the bitmaps are written once. A window over one narrow row
per shard of an entity decides how runs join across shard edges; its result is joined back to the
bitmaps, so a hot entity is spread over its shards and only narrow rows of it meet in one task. A row
that spans many shards gives bitmaps for its edges and a single row for all full shards between them.

Defined results: a null in any entity column, begin or end drops the row, and so does an end before
the beginning (compared in rounded units). Repeated rows change nothing. An empty table gives an
empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.store import durable

SHARD_BITS = 21
#: Rows that a task compresses at a time, and shards that a row may fill one by one.
COMPRESS_ROWS, EACH_SHARD = 500_000, 16


def unite(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of closed cell ranges within each group; result sorted by (group, lo)."""
    if not len(lo):
        return group, lo, hi
    order = np.lexsort((lo, group))
    group, lo, hi = group[order], lo[order], hi[order]
    first = np.r_[True, group[1:] != group[:-1]]
    # a running maximum that restarts at each group: lift every group above the ones before it
    span = int(hi.max() - lo.min()) + 2
    lift = (np.cumsum(first) - 1) * span
    reach = np.maximum.accumulate(hi + lift) - lift
    starts = first.copy()
    starts[1:] |= lo[1:] > reach[:-1] + 1
    at = np.flatnonzero(starts)
    ends = np.r_[at[1:], len(lo)] - 1
    return group[at], lo[at], reach[ends]


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``rows`` rows, the last one aside; empty ones are left out."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _compress(n_keys: int):
    """Map side: Arrow batches of (keys..., shard, lo, hi) to one run bitmap per (keys, shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, COMPRESS_ROWS):
            code = np.zeros(batch.num_rows, np.int64)
            for k in range(n_keys + 1):
                own = batch.column(k).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                # re-number after each column so that the code stays below rows squared
                code = np.unique(code * (own.max() + 1) + own, return_inverse=True)[1].astype(np.int64)
            lo = batch.column(n_keys + 1).to_numpy(zero_copy_only=False)
            hi = batch.column(n_keys + 2).to_numpy(zero_copy_only=False)
            group, lo, hi = unite(code, lo, hi)
            some_row = np.zeros(code.max() + 1, np.int64)
            some_row[code] = np.arange(len(code))
            at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            offsets = pa.array(np.r_[at, len(group)].astype(np.int32))
            rows = pa.array(some_row[group[at]])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(rows) for k in range(n_keys + 1)), pa.ListArray.from_arrays(offsets, pa.array(lo)), pa.ListArray.from_arrays(offsets, pa.array(hi))],
                names=batch.schema.names,
            )

    return run


def _join_bitmaps(n_keys: int):
    """Reduce side: each row's concatenated run lists to the runs of their union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(n_keys + 1)
            lengths = np.diff(lists.offsets.to_numpy())
            group, lo, hi = unite(np.repeat(np.arange(batch.num_rows), lengths), lists.flatten().to_numpy(zero_copy_only=False), batch.column(n_keys + 2).flatten().to_numpy(zero_copy_only=False))
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(group, minlength=batch.num_rows))].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n_keys + 1)), pa.ListArray.from_arrays(offsets, pa.array(lo)), pa.ListArray.from_arrays(offsets, pa.array(hi))], names=batch.schema.names)

    return run


def _cells(df: DataFrame, keys: list[str], begin: Column, end: Column) -> DataFrame:
    top = 1 << 61  # units beyond it count as null
    inside = lambda c: F.when(c.between(-top, top), c * 2)
    return df.select(*keys, inside(begin).alias("__lo"), inside(end).alias("__hi")).dropna().filter("__hi >= __lo")


def _shard(cell: str, size: int) -> Column:
    return F.expr(f"{cell} div {size} - if({cell} % {size} < 0, 1, 0)")


def shard_bitmaps(df: DataFrame, keys: list[str], begin: Column, end: Column, shard_bits: int = SHARD_BITS) -> DataFrame:
    """Run bitmaps (keys, shard, lo, hi): ``lo``/``hi`` are the first/last cells of the runs.

    Full shards between the edges of rows that span more than ``EACH_SHARD`` are left to ``full_shards``.
    """
    size = 1 << shard_bits
    first, last = _shard("__lo", size), _shard("__hi", size)
    shards = F.when(last - first <= EACH_SHARD, F.sequence(first, last)).otherwise(F.array(first, last))
    cells = _cells(df, keys, begin, end).select(*keys, F.explode(shards).alias("__shard"), "__lo", "__hi")
    cells = cells.select(*keys, "__shard", F.greatest("__lo", F.col("__shard") * size).alias("__lo"), F.least("__hi", (F.col("__shard") + 1) * size - 1).alias("__hi"))
    fields = [T.StructField(k, cells.schema[k].dataType) for k in [*keys, "__shard"]]
    packed = T.StructType([*fields, T.StructField("__lo", T.ArrayType(T.LongType())), T.StructField("__hi", T.ArrayType(T.LongType()))])
    parts = cells.mapInArrow(_compress(len(keys)), packed)
    whole = (
        parts.groupBy(*keys, "__shard")
        .agg(F.collect_list(F.struct("__lo", "__hi")).alias("p"))
        .select(*keys, "__shard", F.flatten("p.__lo").alias("__lo"), F.flatten("p.__hi").alias("__hi"))
    )
    return whole.mapInArrow(_join_bitmaps(len(keys)), packed)


def full_shards(df: DataFrame, keys: list[str], begin: Column, end: Column, shard_bits: int = SHARD_BITS) -> DataFrame:
    """(keys, shard, to): stretches of full shards inside rows that span many, the longest from each shard."""
    size = 1 << shard_bits
    cells = _cells(df, keys, begin, end).select(*keys, _shard("__lo", size).alias("a"), _shard("__hi", size).alias("b"))
    return cells.filter(f"b - a > {EACH_SHARD}").groupBy(*keys, (F.col("a") + 1).alias("__shard")).agg(F.max(F.col("b") - 1).alias("__to"))


def periods_and_gaps(df: DataFrame, keys: list[str], begin: Column, end: Column, shard_bits: int = SHARD_BITS) -> DataFrame:
    """Merged periods and the gaps between them: (keys, kind, begin, end) in the unit of ``begin``.

    ``begin`` and ``end`` are integer columns. ``kind`` is 'period' or 'gap'.
    """
    size = 1 << shard_bits
    maps = durable(shard_bitmaps(df, keys, begin, end, shard_bits), "bitmaps")
    by = W.partitionBy(*keys).orderBy("__shard")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(None).cast("bigint")
    slim = maps.select(*keys, "__shard", none.alias("__to"), F.element_at("__lo", 1).alias("__first"), F.element_at("__hi", -1).alias("__last"), F.element_at("__lo", -1).alias("__tail"), (F.size("__lo") > 1).alias("__many"))
    full = full_shards(df, keys, begin, end, shard_bits)
    full = full.select(*keys, "__shard", "__to", (F.col("__shard") * size).alias("__first"), ((F.col("__to") + 1) * size - 1).alias("__last"), (F.col("__shard") * size).alias("__tail"), F.lit(False).alias("__many"))
    # shards within a full stretch say nothing more; a stretch that begins in an earlier one is cut
    covered = F.max("__to").over(W.partitionBy(*keys).orderBy("__shard", F.col("__to").desc_nulls_last()).rowsBetween(W.unboundedPreceding, -1))
    slim = slim.unionByName(full).withColumn("__covered", covered)
    slim = slim.filter("__covered is null or coalesce(__to, __shard) > __covered")
    begins = F.greatest("__first", (F.col("__covered") + 1) * size)
    slim = slim.withColumns({"__first": F.when(F.col("__to").isNull(), F.col("__first")).otherwise(begins), "__tail": F.when(F.col("__to").isNull(), F.col("__tail")).otherwise(begins)})
    edges = slim.withColumns({"__prev": F.lag("__last").over(by), "__next": F.lead("__first").over(by)})
    edges = edges.withColumn("__joins", F.coalesce(F.col("__prev") + 1 == F.col("__first"), F.lit(False)))
    # first cell of the run that reaches the end of each shard; unknown where one run fills the shard from before
    edges = edges.withColumn("__tail", F.when(~F.col("__joins") | F.col("__many"), F.col("__tail")))
    edges = edges.withColumn("__open", F.last("__tail", ignorenulls=True).over(before)).select(*keys, "__shard", "__to", "__first", "__last", "__prev", "__next", "__joins", "__open")
    own = edges.filter("__to is null").drop("__first", "__last", "__to").join(maps, [*keys, "__shard"])
    stretch = edges.filter("__to is not null").withColumns({"__lo": F.array("__first"), "__hi": F.array("__last")}).drop("__first", "__last", "__to")
    edges = own.unionByName(stretch)
    runs = edges.select(
        *keys, "__next", "__joins", "__open", F.size("__lo").alias("__n"),
        F.posexplode(F.arrays_zip(F.col("__lo").alias("lo"), F.col("__hi").alias("hi"), F.concat(F.array("__prev"), F.slice("__hi", 1, F.size("__hi") - 1)).alias("before"))).alias("__i", "__run"),
    )
    goes_on = (F.col("__i") == 0) & F.col("__joins")
    carried = (F.col("__i") == F.col("__n") - 1) & F.coalesce(F.col("__next") == F.col("__run.hi") + 1, F.lit(False))
    previous = F.col("__run.before")
    period = F.struct(F.lit("period").alias("kind"), F.when(goes_on, F.col("__open")).otherwise(F.col("__run.lo")).alias("b"), F.col("__run.hi").alias("e"))
    gap = F.struct(F.lit("gap").alias("kind"), previous.alias("b"), F.col("__run.lo").alias("e"))
    both = F.array_compact(F.array(F.when(~carried, period), F.when(~goes_on & previous.isNotNull(), gap)))
    return runs.select(*keys, F.explode(both).alias("r")).select(*keys, F.col("r.kind").alias("kind"), F.expr("r.b div 2").alias("begin"), F.expr("r.e div 2").alias("end"))


def annotated_periods(annotations: DataFrame) -> DataFrame:
    """Periods and gaps in milliseconds of each (file, channel, label).

    Times are rounded to the nearest millisecond before anything is compared; times that are not
    finite numbers count as null. Deliveries of one
    ``annot_id`` repeat the same values, and a union takes a repeated interval once, so they need
    no shuffle of their own.
    """
    ms = lambda c: F.rint(F.col(c) * 1000).try_cast("bigint")
    out = periods_and_gaps(annotations, ["file", "channel", "label"], ms("begin_s"), ms("end_s"))
    return out.select("file", F.col("channel").cast("bigint").alias("channel"), "label", "kind", F.col("begin").alias("begin_ms"), F.col("end").alias("end_ms"))
