"""A linear classifier with squared hinge loss, one against the rest, fitted by Newton steps.

Each step is one pass: partitions sum gradients and curvature for every label, and only those
sums (labels x dim x dim numbers at most) reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class LinearModel:
    """weights: a row a label, the last column its intercept."""

    labels: list[str]
    weights: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:, :-1].T + self.weights[:, -1]


def _sums(rows, w: np.ndarray, labels: int):
    """Loss, gradient and curvature over one partition, for every label."""
    dim = w.shape[1]
    loss, grad, curve = np.zeros(labels), np.zeros((labels, dim)), np.zeros((labels, dim, dim))
    chunk: list = []

    def add():
        x = np.array([[*r["v"], 1.0] for r in chunk])
        own = np.array([r["y"] for r in chunk])
        for k in range(labels):
            y = np.where(own == k, 1.0, -1.0)
            gap = 1 - y * (x @ w[k])
            on = gap > 0
            z = x[on]
            loss[k] += (gap[on] ** 2).sum()
            grad[k] -= 2 * (gap[on] * y[on]) @ z
            curve[k] += 2 * z.T @ z

    for r in rows:
        chunk.append(r)
        if len(chunk) == 4096:
            add()
            chunk = []
    if chunk:
        add()
    yield loss, grad, curve


def fit(df: DataFrame, vector: str, label: str, c: float = 1.0, steps: int = 30, tolerance: float = 1e-8) -> LinearModel:
    """Minimise |w|^2 / 2 + c * sum(max(0, 1 - y w.x)^2) for each label, intercept included."""
    labels = sorted(r[0] for r in df.select(label).distinct().collect())
    if len(labels) < 2:
        dim = len(df.first()[vector]) if labels else 0
        return LinearModel(labels, np.zeros((len(labels), dim + 1)))
    number = F.create_map(*[x for i, s in enumerate(labels) for x in (F.lit(s), F.lit(i))])
    data = df.select(F.col(vector).alias("v"), number[F.col(label)].alias("y")).persist()
    dim, k = len(data.first()["v"]) + 1, len(labels)
    sc = df.sparkSession.sparkContext

    def evaluate(w):
        shared = sc.broadcast(w)
        loss, grad, curve = data.rdd.mapPartitions(lambda rows: _sums(rows, shared.value, k)).treeReduce(lambda a, b: tuple(x + y for x, y in zip(a, b)))
        return (w * w).sum(1) / 2 + c * loss, w + c * grad, np.eye(dim) + c * curve

    w = np.zeros((k, dim))
    value, grad, curve = evaluate(w)
    size = np.ones(k)
    for _ in range(steps):
        step = np.linalg.solve(curve, grad[:, :, None])[:, :, 0]
        tried = w - size[:, None] * step
        new_value, new_grad, new_curve = evaluate(tried)
        better = new_value <= value
        moved = np.abs(value - new_value)[better].max(initial=0.0)
        w = np.where(better[:, None], tried, w)
        value, grad = np.where(better, new_value, value), np.where(better[:, None], new_grad, grad)
        curve = np.where(better[:, None, None], new_curve, curve)
        size = np.where(better, 1.0, size / 2)
        if better.all() and moved < tolerance * max(1.0, np.abs(value).max()):
            break
    data.unpersist()
    return LinearModel(labels, w)


def predict(model: LinearModel, df: DataFrame, vector: str) -> DataFrame:
    """df with the best label and its margin over the second (with two labels, the scores'
    distance from each other halved, as one decision value would give)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<predicted:string,margin:double>")
    def run(v: pd.Series) -> pd.DataFrame:
        m = shared.value
        if not m.labels:
            return pd.DataFrame({"predicted": [None] * len(v), "margin": 0.0})
        s = m.scores(np.array(v.tolist(), float).reshape(len(v), -1))
        best = s.argmax(1)
        if s.shape[1] == 1:
            gap = np.abs(s[:, 0])
        else:
            top = np.sort(s, axis=1)[:, -2:]
            gap = (top[:, 1] - top[:, 0]) / (2 if s.shape[1] == 2 else 1)
        return pd.DataFrame({"predicted": np.array(m.labels, object)[best], "margin": gap})

    return df.withColumn("_s", run(vector)).select(*df.columns, "_s.predicted", "_s.margin")
