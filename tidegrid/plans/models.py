"""Models as bundles that score batches of clips, their training, and the scoring UDF.

A bundle is a folder with weights (npz) and JSON sidecars (class list, audio and spectral settings).
Any object with ``score(batch) -> [n, classes]`` can take a ``LinearModel``'s place in the scorer,
deep networks included; only linear ones are trained here, with ``pyspark.ml``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.sources import assets


@dataclass
class LinearModel:
    """Scores ``features @ weights.T + bias``, then sigmoid (several labels) or softmax (one)."""

    weights: np.ndarray
    bias: np.ndarray
    classes: list[str]
    multilabel: bool = True

    def score(self, batch: np.ndarray) -> np.ndarray:
        z = batch @ self.weights.T + self.bias
        if self.multilabel:
            return 1 / (1 + np.exp(-z))
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def save(self, folder: str, audio: dict | None = None, spectral: dict | None = None) -> None:
        Path(folder).mkdir(parents=True, exist_ok=True)
        np.savez(Path(folder, "weights.npz"), weights=self.weights, bias=self.bias, multilabel=self.multilabel)
        assets.write_json(folder, assets.CLASSES, self.classes)
        assets.write_json(folder, assets.AUDIO, audio or {})
        assets.write_json(folder, assets.SPECTRAL, spectral or {})

    @classmethod
    def load(cls, folder: str) -> LinearModel:
        with np.load(Path(folder, "weights.npz")) as z:
            return cls(z["weights"], z["bias"], assets.read_json(folder, assets.CLASSES), bool(z["multilabel"]))


def scorer(spark, model):
    """Column function: array<double> features (or clip) to array<double> scores, in Arrow batches.

    Null arrays give null; arrays of another length than the batch's fail the task.
    """
    # a model's size is fixed by its architecture; packed so that its class travels along
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(model))

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = cloudpickle.loads(shared.value)
        for batch in batches:
            known = batch.notna().to_numpy()
            out: list = [None] * len(batch)
            if known.any():
                for i, row in zip(np.flatnonzero(known), own.score(np.stack([np.asarray(x, float) for x in batch[known]])), strict=True):
                    out[i] = row
            yield pd.Series(out)

    return run


def score_rows(scored: DataFrame, keys: list[str], column: str = "scores") -> DataFrame:
    """One row per class of a scores array: (keys, class_idx, score)."""
    return scored.select(*keys, F.posexplode(column).alias("class_idx", "score"))


def train_linear(rows: DataFrame, features: str, target: str, classes: list[str], multilabel: bool = False, weighted: bool = True, l2: float = 0.0, iterations: int = 50) -> tuple[LinearModel, dict]:
    """Fit on all rows: (model, history). ``target`` is a class index, or an array of 0/1 if multilabel.

    With ``weighted``, rows count by the inverse frequency of their class.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    base = rows.filter(F.col(features).isNotNull() & F.col(target).isNotNull()).withColumn("__x", array_to_vector(F.transform(features, lambda v: v.cast("double"))))
    history: dict = {"loss": []}

    def fit(df: DataFrame, family: str):
        n = df.groupBy("__y").agg(F.count("*").alias("__n"))
        total, kinds = n.agg(F.sum("__n"), F.count("*")).first()
        df = df.join(F.broadcast(n), "__y").withColumn("__w", F.lit(float(total)) / (kinds * F.col("__n")) if weighted else F.lit(1.0))  # one row per class
        fitted = LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__w", family=family, regParam=l2, maxIter=iterations).fit(df)
        history["loss"].append(list(fitted.summary.objectiveHistory))
        return fitted

    if not multilabel:
        fitted = fit(base.withColumn("__y", F.col(target).cast("double")), "multinomial")
        w = fitted.coefficientMatrix.toArray()
        grown = np.zeros((len(classes), w.shape[1]))
        bias = np.full(len(classes), -50.0)
        grown[: len(w)], bias[: len(w)] = w, fitted.interceptVector.toArray()
        return LinearModel(grown, bias, classes, False), history
    weights, bias = [], []
    for k in range(len(classes)):
        fitted = fit(base.withColumn("__y", (F.col(target)[k] >= 0.5).cast("double")), "binomial")
        weights.append(fitted.coefficients.toArray())
        bias.append(fitted.intercept)
    return LinearModel(np.array(weights), np.array(bias), classes, True), history
