"""Interval sets against interval sets: how much of each base interval the union of others covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of a time bucket of the range join.
BUCKET_S = 60.0


def _bucketed(rows: DataFrame, columns: list[str], bucket_s: float) -> DataFrame:
    lo, hi = F.floor(F.col("b") / bucket_s), F.floor(F.col("e") / bucket_s)
    return rows.select(*columns, "b", "e", F.explode(F.sequence(lo, hi)).alias("bucket"))


def covered_parts(base: DataFrame, items: DataFrame, keys: list[str], bucket_s: float = BUCKET_S, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, by..., covered) of base rows (keys, id, b, e) that the union of items (keys, b, e, by...) meets.

    ``covered`` is in seconds; items with different ``by`` are united apart. The range join is an
    equi-join on the keys and a time bucket, so a hot key is spread over its buckets. Items are cut at
    bucket edges and united within each bucket first: a base interval meets disjoint items only, and
    what each bucket measures is added up. Intervals without length cover nothing.
    """
    base, items = _good(base, keys), _good(items, keys, by)
    cut = lambda x: x.withColumns({"b": F.greatest("b", F.col("bucket") * bucket_s), "e": F.least("e", (F.col("bucket") + 1) * bucket_s)})
    x = cut(_bucketed(base, [*keys, "id"], bucket_s))
    y = cut(_bucketed(items, [*keys, *by], bucket_s)).filter("e > b")
    place = W.partitionBy(*keys, *by, "bucket").orderBy("b", "e")
    y = y.withColumn("reach", F.max("e").over(place.rowsBetween(W.unboundedPreceding, -1)))
    y = y.withColumn("island", F.count(F.when(F.col("reach").isNull() | (F.col("b") > F.col("reach")), 1)).over(place.rowsBetween(W.unboundedPreceding, 0)))
    y = y.groupBy(*keys, *by, "bucket", "island").agg(F.min("b").alias("ib"), F.max("e").alias("ie"))
    hits = x.join(y, [*keys, "bucket"]).filter("ib < e and ie > b")
    return hits.groupBy("id", *by).agg(F.sum(F.least("e", "ie") - F.greatest("b", "ib")).alias("covered"))


def _good(rows: DataFrame, keys: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    own = [c for c in ("id",) if c in rows.columns]
    return rows.select(*keys, *own, "b", "e", *more).dropna(subset=[*keys, "b", "e", *own]).filter("e >= b and not isnan(b) and not isnan(e)")


def union_coverage(base: DataFrame, items: DataFrame, keys: list[str], bucket_s: float = BUCKET_S) -> DataFrame:
    """Base rows (keys, id, b, e) with ``covered``: seconds of them within the union of the items.

    Rows with a null or with the end before the beginning are left out.
    """
    total = covered_parts(base, items, keys, bucket_s)
    return _good(base, keys).join(total, "id", "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))


def covers(covered, share: float, begin: str = "b", end: str = "e"):
    """Is enough of an interval covered? One without length is."""
    return covered >= (F.col(end) - F.col(begin)) * share - 1e-9


def match_detections(truth: DataFrame, found: DataFrame, keys: list[str], min_gt: float = 0.5, min_det: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Truth rows with ``recalled`` and detection rows with ``true_positive``.

    Each side is compared with the union of the other; an interval without length counts as covered.
    """
    recalled = union_coverage(truth, found, keys).withColumn("recalled", covers(F.col("covered"), min_gt))
    return recalled, union_coverage(found, truth, keys).withColumn("true_positive", covers(F.col("covered"), min_det))
