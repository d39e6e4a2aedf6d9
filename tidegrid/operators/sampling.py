"""Feeder operators: per-class picks, splits, class floors, weights, one-hot labels.

Random order is the md5 of the row's key and a seed, so a pick does not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.store import broadcast_if_small


#: Parts that a class is sorted in when a cap is given.
SALTS = 64


def shuffled(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))


def pick_per_class(rows: DataFrame, class_col: str, key: str, seed: int, cap: int | None = None, validation: float = 0.0) -> DataFrame:
    """Rows picked per class with their part: 'train' or 'validation'.

    The first ``cap`` rows of the class's random order are kept, and the last half-even rounded
    ``validation`` share of those is for validation. A row with several classes may be picked by each.
    """
    order = [shuffled(key, seed), key]
    total = rows.groupBy(class_col).agg(F.count("*").alias("n"))
    first = rows
    if cap is not None:
        # the first of each salt hold the first of all, so a hot class is sorted in parts
        salt = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(SALTS))
        first = rows.withColumn("__salt", salt).withColumn("__rank", F.row_number().over(W.partitionBy(class_col, "__salt").orderBy(*order)))
        first = first.filter(F.col("__rank") <= cap).drop("__salt", "__rank")
    kept = F.least("n", F.lit(cap)) if cap is not None else F.col("n")
    out = first.withColumn("rank", F.row_number().over(W.partitionBy(class_col).orderBy(*order)))
    out = out.join(broadcast_if_small(total), class_col).withColumn("kept", kept).filter("rank <= kept")
    return out.withColumn("part", F.when(F.col("rank") > F.col("kept") - F.rint(F.col("kept") * validation), "validation").otherwise("train")).drop("n", "kept")


def disjoint_parts(picked: DataFrame, key: str) -> DataFrame:
    """Picks in which a row in both parts stays in training only."""
    first = picked.groupBy(key).agg(F.min("part").alias("part"))
    return picked.drop("part").join(first, key)


def classes_with(rows: DataFrame, class_col: str, least: int) -> DataFrame:
    """Rows of the classes with at least ``least`` rows."""
    enough = rows.groupBy(class_col).count().filter(F.col("count") >= least).select(class_col)
    return rows.join(broadcast_if_small(enough), class_col, "left_semi")


def class_weights(rows: DataFrame, class_col: str) -> DataFrame:
    """(class, weight): total over number of classes times the class's rows."""
    n = rows.groupBy(class_col).agg(F.count("*").alias("n"))
    everything = W.partitionBy()  # one row per class
    return n.select(class_col, (F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))).alias("weight"))


def one_hot(labels: Column) -> Column:
    """1 at the first of the largest labels, 0 elsewhere; null stays null."""
    hot = lambda top: F.transform(labels, lambda x, i: F.when(i == top - 1, 1.0).otherwise(0.0).cast("float"))
    return F.element_at(F.transform(F.array(F.array_position(labels, F.array_max(labels))), hot), 1)
