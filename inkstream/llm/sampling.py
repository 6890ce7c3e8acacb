"""Small things the learning operators share: held-out rows, bounded samples of labelled rows, logistic fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; null for a null key."""
    return F.crc32(key.cast("string")) % divisor


def labelled_sample(
    labels: DataFrame, key: str, label: str, per_class: int, classes: tuple[int, ...] = (0, 1), salt: int = 0
) -> DataFrame:
    """``key`` and ``label`` of at most ``per_class`` rows of each class, chosen by a hash of the key.

    Several labels of one key count as one, the largest.  Each class is a bounded top-k, so a task passes on no more
    than ``per_class`` rows.
    """
    one = labels.where(labels[key].isNotNull() & labels[label].isNotNull()).groupBy(key).agg(F.max(label).alias(label))
    parts = [
        one.where(F.col(label) == c).orderBy(F.xxhash64(F.lit(salt), key), key).limit(per_class) for c in classes
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fit_logistic(
    features: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 50
) -> np.ndarray:
    """Coefficients (intercept first) of a ridge logistic regression by Newton steps; features should be scaled."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.ones(len(x)) if weights is None else weights
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (p - labels)) + penalty * beta
        hessian = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def logistic(beta: np.ndarray, features: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(beta[0] + features @ beta[1:], -30, 30)))
