"""Class spaces: discovery, indices, remaps, negative class.

``LabelSpace`` decides on the driver (class lists are small by nature) what each label becomes; the
mapping then joins as a small dimension whose size is checked before it is broadcast.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.store import broadcast_if_small


def discover_labels(annotations: DataFrame) -> DataFrame:
    """(label, n) of all non-null labels."""
    return annotations.filter("label is not null").groupBy("label").agg(F.count("*").alias("n"))


@dataclass
class LabelSpace:
    """Ordered class list with the labels that lead to each class.

    ``fixed``: the list may not grow; only labels outside it may be remapped, and only onto it.
    Otherwise labels may be merged or renamed, and the list is sorted again. The negative label is
    appended if missing and can't be remapped away. Remaps whose target is itself remapped (or the
    same) are refused; unusable ones are reported and ignored.
    """

    classes: list[str]
    remap: dict[str, str] = field(default_factory=dict)
    negative: str | None = None
    fixed: bool = True
    assessing: bool = False

    def __post_init__(self):
        if any(dst in self.remap for dst in self.remap.values()):
            raise ValueError("chained, circular or self remaps are not allowed")
        known = list(self.classes)
        if self.negative is not None and self.negative not in known:
            if self.assessing:
                self.negative = None
            else:
                known.append(self.negative)
        used = {}
        for src, dst in self.remap.items():
            if src == self.negative:
                warnings.warn("the negative class can't be remapped", stacklevel=2)
            elif self.fixed and (src in known or dst not in known):
                warnings.warn(f"remap of {src!r} to {dst!r} ignored: the class list is fixed", stacklevel=2)
            elif not self.fixed and src not in known and dst not in known:
                warnings.warn(f"remap of {src!r} to {dst!r} ignored: neither is known", stacklevel=2)
            else:
                used[src] = dst
        if not self.fixed:
            kept = [c for c in known if c not in used]
            known = sorted({*kept, *used.values()})
        self.class_list, self.used = known, used

    @property
    def negative_index(self) -> int | None:
        return None if self.negative is None else self.class_list.index(self.negative)

    def index_of(self) -> dict[str, int]:
        """Every label that means a class, with the class's index."""
        own = {c: i for i, c in enumerate(self.class_list)}
        return own | {src: own[dst] for src, dst in self.used.items()}

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(sorted(self.index_of().items()), "label string, class_idx int")


def map_labels(rows: DataFrame, classes: DataFrame, remap: DataFrame | None = None) -> DataFrame:
    """Rows whose label means a class, with ``class_idx``; the others are dropped.

    A label of the class list stays as it is; another one goes through ``remap`` (src, dst) if its
    target is in the list.
    """
    known = classes.select("label", "class_idx").dropna()
    if remap is not None:
        more = remap.join(broadcast_if_small(known.select("label").distinct()), remap["src"] == F.col("label"), "left_anti")
        known = known.union(more.join(broadcast_if_small(known), more["dst"] == known["label"]).select("src", "class_idx"))
    return rows.join(broadcast_if_small(known.distinct()), "label")


def reject_classes(rows: DataFrame, rejected: list[int]) -> DataFrame:
    """Rows of the classes that are not rejected."""
    return rows.filter(~F.col("class_idx").isin(rejected)) if rejected else rows


def file_level_labels(clips: DataFrame, class_idx: str, n_classes: int) -> DataFrame:
    """Every clip labelled one-hot by its file's class."""
    return clips.withColumn("labels", F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda i: F.when(i == F.col(class_idx), 1.0).otherwise(0.0).cast("float")))
