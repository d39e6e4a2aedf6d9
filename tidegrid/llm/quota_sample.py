"""Samples that match target class proportions, with floors and a report of gaps.

Class moments are aggregated distributedly (map-side combined counts). On these moments the
exponential-tilting dual is solved by Newton iterations for every plan: a unit of class ``k`` starts
from ``fraction_k * size / at_hand_k`` and is tilted by ``exp(lambda)`` for the total; classes at their
floor, or at what is at hand, stay there. The sample is drawn with these
probabilities by the pivotal method: sequentially within blocks of a class (a hot class has many
blocks), then among the one undecided unit that each block may leave.

Defined results: a clip's class is the position of the largest of its labels, the first of equals;
null labels, labels without a positive value, and clips outside the train split have none. NaN and
null label values count as absent. Target rows with a null field are left out; of rows with the
same (plan, class) the largest values count. Plans whose targets add up to nothing give no sample. A clip
that comes in several rows counts once.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (plan, class) rows that are solved on the driver; the targets are a fixed table.
MAX_TARGETS = 100_000
#: Units of one block of the sequential pivotal method.
BLOCK = 2000


def label_class(labels: Column) -> Column:
    """Position of the largest positive label, the first of equals; null if there is none."""
    clean = F.transform(labels, lambda x: F.when(~F.isnan(x), x))
    top = F.array_max(clean)
    return F.when(top > 0, F.array_position(clean, top) - 1).cast("int")


def labelled_clips(prepared: DataFrame, split: str = "train") -> DataFrame:
    """(clip_id, class_idx) of the clips of a split that have a class; each clip once, in its lowest class."""
    own = prepared.filter(F.col("split") == split).select("clip_id", label_class(F.col("labels")).alias("class_idx"))
    return own.dropna().groupBy("clip_id").agg(F.min("class_idx").alias("class_idx"))


def tilt(moments: np.ndarray, low: np.ndarray, high: np.ndarray, total: float, tolerance: float = 1e-9, steps: int = 200) -> float:
    """Multiplier ``lambda`` of the total in the exponential-tilting dual with bounded classes.

    Solves ``sum(clip(moments * exp(lambda), low, high)) = total`` by Newton steps on the classes that
    are off their bounds; a step that leaves the bracket of the root is replaced by its middle.
    """
    some = moments > 0
    lam, least, most = 0.0, -80.0, 80.0
    for _ in range(steps):
        raw = moments * np.exp(lam)
        gradient = np.clip(raw, low, high).sum() - total
        if abs(gradient) <= tolerance * max(1.0, total):
            break
        least, most = (lam, most) if gradient < 0 else (least, lam)
        slope = raw[some & (raw > low) & (raw < high)].sum()
        step = lam - gradient / slope if slope > 0 else np.nan
        lam = step if least < step < most else (least + most) / 2
    return lam


def calibrate(fraction: np.ndarray, floor: np.ndarray, at_hand: np.ndarray, size: float) -> np.ndarray:
    """Expected clips of each class, adding up to ``size`` wherever floors and what is at hand allow it.

    Within its bounds (its floor, what is at hand) each class gets its fraction of ``size`` times one
    factor, the tilt of the total: what floors add, the other classes give up in proportion, and what an
    exhausted class lacks, they make up. Floors win if they alone exceed ``size``; a class without a
    fraction gets its floor.
    """
    high = at_hand.astype(float)
    low = np.minimum(floor, at_hand).astype(float)
    moments = fraction * size
    high = np.where(moments > 0, high, low)
    total = min(max(size, low.sum()), high.sum())
    return np.clip(moments * np.exp(tilt(moments, low, high, total)), low, high)


def plan_report(prepared: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per (plan, class): at hand, wanted, expected clips, inclusion probability and gap."""
    spark = prepared.sparkSession
    t = targets.select("plan_id", "class_idx", F.rint(F.col("fraction") * 10000).cast("bigint").alias("f4"), F.col("min_clips").cast("bigint").alias("min_clips"), F.col("sample_size").cast("bigint").alias("sample_size"))
    t = t.dropna().groupBy("plan_id", "class_idx").agg(*[F.max(c).alias(c) for c in ("f4", "min_clips", "sample_size")])
    counts = labelled_clips(prepared).groupBy("class_idx").agg(F.count("*").alias("at_hand"))
    rows = t.join(counts, "class_idx", "left").select("plan_id", "class_idx", "f4", "min_clips", "sample_size", F.coalesce("at_hand", F.lit(0)).alias("at_hand")).limit(MAX_TARGETS + 1).toPandas()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target rows")
    rows["wanted"] = np.maximum(rows.min_clips, -(-rows.f4 * rows.sample_size // 10000)).astype(np.int64)
    rows["expected"] = 0.0
    for _, own in rows.groupby("plan_id"):
        rows.loc[own.index, "expected"] = calibrate(own.f4.to_numpy() / 1e4, own.min_clips.to_numpy(), own.at_hand.to_numpy(), float(own.sample_size.max()))
    rows["probability"] = np.where(rows.at_hand > 0, rows.expected / np.maximum(rows.at_hand, 1), 0.0).clip(0, 1)
    rows["gap"] = np.maximum(0, rows.wanted - rows.at_hand)
    columns = ["plan_id", "class_idx", "at_hand", "wanted", "expected", "probability", "gap"]
    schema = "plan_id bigint, class_idx bigint, at_hand bigint, wanted bigint, expected double, probability double, gap bigint"
    return spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in rows[columns].itertuples(index=False)], schema)


def unreachable(prepared: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan_id, class_idx) of the targets with fewer clips at hand than wanted."""
    return plan_report(prepared, targets).filter("gap > 0").select("plan_id", "class_idx")


def _duel(p: float, q: float, u: float) -> tuple[float, float]:
    """One step of the pivotal method: the new probabilities of both units."""
    s = p + q
    if s < 1:
        return (s, 0.0) if u * s < p else (0.0, s)
    return (1.0, s - 1) if u * (2 - s) < 1 - q else (s - 1, 1.0)


def _pivotal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequential pivotal method over rows sorted by ``grp``; emits chosen and undecided units."""
    pending: dict | None = None
    schema = None
    for batch in batches:
        schema = batch.schema
        keep: list[dict] = []
        for row in batch.to_pylist():
            if pending is not None and pending["grp"] != row["grp"]:
                keep.append(pending)
                pending = None
            if row["p"] >= 1:
                keep.append(row)
            elif pending is None:
                pending = row
            else:
                a, b = _duel(pending["p"], row["p"], row["u"])
                pending["p"], row["p"] = a, b
                if a >= 1 - 1e-12:
                    keep.append(pending | {"p": 1.0})
                    pending = row if b > 1e-12 else None
                elif b >= 1 - 1e-12:
                    keep.append(row | {"p": 1.0})
                    pending = pending if a > 1e-12 else None
                else:
                    pending = pending if a > 0 else row
        yield pa.RecordBatch.from_pylist(keep, schema=schema)
    if pending is not None:
        yield pa.RecordBatch.from_pylist([pending], schema=schema)


def draw(prepared: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """The sample of every plan: (plan_id, clip_id, class_idx). The same seed gives the same rows."""
    spark = prepared.sparkSession
    report = plan_report(prepared, targets).filter("probability > 0")
    probabilities = F.broadcast(report.select("plan_id", "class_idx", "probability", (F.col("at_hand") / BLOCK + 1).cast("int").alias("blocks")))  # at most MAX_TARGETS rows
    draw_at = lambda salt: F.pmod(F.xxhash64("clip_id", "plan_id", F.lit(seed), F.lit(salt)), F.lit(1 << 52)) / float(1 << 52)
    units = labelled_clips(prepared).join(probabilities, "class_idx")
    block = F.pmod(F.xxhash64("clip_id", F.lit(seed)), F.col("blocks"))
    units = units.select(F.concat_ws(":", "plan_id", "class_idx", block).alias("grp"), F.col("plan_id").cast("bigint").alias("plan_id"), F.col("class_idx").cast("bigint").alias("class_idx"), F.col("clip_id").cast("bigint").alias("clip_id"), F.col("probability").alias("p"), draw_at("block").alias("u"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = units.repartition(n, "grp").sortWithinPartitions("grp", F.xxhash64("clip_id", F.lit(seed))).mapInArrow(_pivotal, units.schema)
    # the undecided units of a class settle among themselves, so a class with a whole target meets it exactly
    within = first.filter("p < 1").withColumns({"grp": F.concat_ws(":", "plan_id", "class_idx"), "u": draw_at("class")})
    within = within.repartition(n, "grp").sortWithinPartitions("grp", "clip_id").mapInArrow(_pivotal, units.schema)
    # then those left of a plan, in the order of their classes: counts stay within one of the target
    undecided = within.filter(F.col("p").between(1e-9, 1 - 1e-9)).withColumns({"grp": F.col("plan_id").cast("string"), "u": draw_at("rest")})
    second = undecided.repartition(n, "grp").sortWithinPartitions("grp", "class_idx", "clip_id").mapInArrow(_pivotal, units.schema)
    return first.filter("p >= 1").union(within.filter(F.col("p") > 1 - 1e-9)).union(second.filter("p > 0.5")).select("plan_id", "clip_id", "class_idx")
