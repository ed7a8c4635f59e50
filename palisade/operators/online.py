"""A logistic regression that learns batch by batch, without its history.

What earlier batches have taught is kept as a point and a curvature (the weights
and the Hessian of the penalised loss there, 35 x 35 numbers), which stand for
their loss as a parabola.  A batch is added by Newton steps on its own loss
plus that parabola, warm-started at the old weights: a few passes over the batch,
whose gradients and Hessians are summed in Spark.  The cost of a batch does not
depend on what came before; while weights settle, so does the error (Opper and
Winther's online Gaussian approximation, 1998).

The state after a batch is a one-row table named by the batch.  A batch that
comes again finds its state and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import feature_names
from ..sources.sinks import path_exists
from .ml import standardization, with_features

STATE = "batch long, rows long, weights array<double>, curvature array<double>, means array<double>, deviations array<double>"


def batch_sums(features: DataFrame, weights: np.ndarray, means: np.ndarray, deviations: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient, Hessian and loss of the log loss at ``weights`` (the last is the intercept), summed over rows (feature columns, ``label``)."""
    names, size = feature_names(), len(weights)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + size * size + 1)
        for part in parts:
            raw = np.column_stack([part.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names])
            x = np.hstack([(raw - means) / deviations, np.ones((len(raw), 1))])
            y = part.column("label").to_numpy(zero_copy_only=False).astype(float)
            z = x @ weights
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x
            total += np.concatenate([x.T @ (p - y), hessian.ravel(), [(np.logaddexp(0, z) - y * z).sum()]])
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(total)), pa.int64()), "value": pa.array(total)})

    summed = features.select(*(F.col(f"`{n}`").cast("double").alias(n) for n in names), F.col("label").cast("double")).mapInArrow(run, "place long, value double")
    rows = summed.groupBy("place").agg(F.sum("value").alias("value")).collect()  # as many as there are numbers in a gradient and a Hessian
    out = np.zeros(size + size * size + 1)
    for r in rows:
        out[r.place] = r.value
    return out[:size], out[size:-1].reshape(size, size), float(out[-1])


def _featured(df: DataFrame, text_col: str | None, *others: Column) -> DataFrame:
    """The feature columns (those of ``df`` itself without ``text_col``) and others."""
    if text_col is None:
        return df.select(*(F.col(f"`{n}`") for n in feature_names()), *others)
    return with_features(df.select(F.col(text_col).alias("_text"), *others), "_text").drop("_text")


@dataclass(frozen=True)
class OnlineModel:
    """Weights over standardised features and the intercept, with the curvature of all that was learned.

    Where ``text_col`` is None, the rows have their features already (see with_features):
    for tables that are read more than once.
    """

    weights: np.ndarray
    curvature: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    rows: int = 0
    batch: int = -1

    @classmethod
    def start(cls, samples: DataFrame, text_col: str | None = "text", label_col: str = "label", c: float = 1.0) -> OnlineModel:
        """A model that has learned its first samples, which also set the scale of the features (penalty 1 / (2 c), none on the intercept)."""
        names = feature_names()
        scale = standardization(_featured(samples, text_col))
        size = len(names) + 1
        penalty = np.diag([1 / c] * len(names) + [1e-9])
        empty = cls(np.zeros(size), penalty, np.array([scale[n][0] for n in names]), np.array([scale[n][1] for n in names]))
        return empty.learned(samples, text_col, label_col)

    def learned(self, batch: DataFrame, text_col: str | None = "text", label_col: str = "label", most: int = 25) -> OnlineModel:
        """The model after one batch more; rows without a label are left out."""
        features = _featured(batch.where(F.col(label_col).isNotNull()), text_col, F.col(label_col).alias("label")).persist()
        rows = features.count()
        if not rows:
            features.unpersist()
            return self
        old, w = self.weights, self.weights.copy()
        held = lambda v: 0.5 * (v - old) @ self.curvature @ (v - old)
        gradient, hessian, loss = batch_sums(features, w, self.means, self.deviations)
        for _ in range(most):
            slope = gradient + self.curvature @ (w - old)
            move = np.linalg.solve(hessian + self.curvature, slope)
            if np.abs(move).max() < 1e-9:
                break
            share, before = 1.0, loss + held(w)
            while True:  # halved until the loss does not grow
                new = w - share * move
                found = batch_sums(features, new, self.means, self.deviations)
                if found[2] + held(new) <= before + 1e-12 * abs(before) or share < 1e-6:
                    break
                share /= 2
            w, (gradient, hessian, loss) = new, found
        features.unpersist()
        return replace(self, weights=w, curvature=self.curvature + hessian, rows=self.rows + rows)

    def score(self, df: DataFrame, text_col: str | None) -> DataFrame:
        """Adds ml_score, the probability of label 1: one expression."""
        terms: Column = F.lit(float(self.weights[-1]))
        for n, w, m, s in zip(feature_names(), self.weights, self.means, self.deviations, strict=False):
            terms = terms + (F.col(f"`{n}`") - F.lit(float(m))) * F.lit(float(w / s))
        features = df if text_col is None else with_features(df, text_col)
        return features.withColumn("ml_score", 1 / (1 + F.exp(-terms))).select(*df.columns, "ml_score")

    def save(self, spark: SparkSession, folder: str) -> None:
        row = (self.batch, self.rows, self.weights.tolist(), self.curvature.ravel().tolist(), self.means.tolist(), self.deviations.tolist())
        spark.createDataFrame([row], STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={self.batch}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, batch: int) -> OnlineModel:
        r = spark.read.schema(STATE).parquet(f"{folder}/batch={batch}").first()
        size = len(r.weights)
        return cls(np.array(r.weights), np.array(r.curvature).reshape(size, size), np.array(r.means), np.array(r.deviations), r.rows, batch)


def online_learner(folder: str, text_col: str | None = "text", label_col: str = "label") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: learns from a batch of (text, label), or of features and label, and leaves the state of the batch in ``folder``.

    Save the model that the stream begins with there first (its batch is -1).
    A batch whose state is there, complete, is not learned again.
    """

    def learn(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not path_exists(spark, f"{folder}/batch={number}/_SUCCESS"):
            model = OnlineModel.load(spark, folder, number - 1).learned(batch, text_col, label_col)
            replace(model, batch=number).save(spark, folder)

    return learn
