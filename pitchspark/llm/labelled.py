"""Bounded samples of labelled documents, and what classifiers fitted on them share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchspark.llm.common import in_fold


def labelled_sample(
    labels: DataFrame, label: str, per_class: int, folds: int, fold: int
) -> tuple[list[tuple], dict[int, int]]:
    """Up to ``per_class`` (doc_id, label) pairs of label 0 and of label 1, those with the smallest
    hashes of their ids, of all rows outside the held-out fold; and how many rows each label has.
    Rows without id or with another label count for nothing."""
    value = labels[label].cast("int")
    usable = labels.where(
        value.isin(0, 1) & labels["doc_id"].isNotNull() & ~in_fold(labels["doc_id"], folds, fold)
    ).select("doc_id", value.alias("label"))
    totals = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    sample = []
    for c in totals:
        # Spark keeps only the smallest rows of each task.
        order = usable.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id")
        sample += [tuple(r) for r in order.limit(per_class).collect()]
    return sample, totals


def calibrated(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that turns margins into probabilities, by Newton's
    method with a small penalty; the labels are drawn in a little, so that none is certain."""
    weight = weight / weight.sum() * len(weight)
    centre, scale = margin.mean(), margin.std() or 1.0
    x = np.stack([(margin - centre) / scale, np.ones(len(margin))], axis=1)
    up = weight[label == 1].sum()
    down = weight[label == 0].sum()
    goal = np.where(label == 1, (up + 1) / (up + 2), 1 / (down + 2))
    w = np.array([1.0, np.log((up + 1) / (down + 1))])
    penalty = np.diag([1e-2, 1e-6])
    for _ in range(50):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - goal)) + penalty @ w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(curve, gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1] - w[0] * centre / scale)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
