"""Logistic regression by Newton steps, and a certificate for coefficients from any solver.

The penalised mean loss is mean(log(1 + exp(-s z))) + penalty / 2 * sum(w^2), with z = w x + b, s = 1 or -1, and b free.
It is convex, so a gradient of zero proves a minimum.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Certificate:
    """Gradient and loss of given coefficients; ``steepest`` is the gradient's largest entry."""

    loss: float
    gradient: list[float]
    curvature: np.ndarray | None = None

    @property
    def steepest(self) -> float:
        return max(map(abs, self.gradient), default=0.0)


def _total(terms: list[Column]) -> Column:
    return sum(terms[1:], terms[0])


def sums_at(frame: DataFrame, features: Sequence[Column], label: Column, weights: Sequence[float], intercept: float, penalty: float) -> Certificate:
    """Loss, gradient and curvature at the given coefficients, of one aggregate over the table; rows with a null are left out."""
    x = [*features, F.lit(1.0)]
    names = [f"x{i}" for i in range(len(x))]
    rows = frame.select(*[c.cast("double").alias(n) for c, n in zip(x, names)], label.cast("double").alias("y")).dropna()
    z = _total([F.col(n) * F.lit(float(w)) for n, w in zip(names, [*weights, intercept])])
    rows = rows.withColumn("z", z).withColumn("p", F.when(F.col("z") >= 0, 1 / (1 + F.exp(-F.col("z")))).otherwise(F.exp("z") / (1 + F.exp("z"))))
    loss = F.greatest(F.col("z"), F.lit(0.0)) - F.col("z") * F.col("y") + F.log1p(F.exp(-F.abs("z")))
    pairs = [(i, j) for i in range(len(x)) for j in range(i + 1)]
    spread = F.col("p") * (1 - F.col("p"))
    row = rows.agg(
        F.count(F.lit(1)), F.sum(loss), *[F.sum((F.col("p") - F.col("y")) * F.col(n)) for n in names],
        *[F.sum(spread * F.col(names[i]) * F.col(names[j])) for i, j in pairs]).first()
    n = row[0]
    if not n:
        return Certificate(0.0, [0.0] * len(x), np.zeros((len(x), len(x))))
    w = np.array([*weights, 0.0])
    gradient = np.array(row[2: 2 + len(x)]) / n + penalty * w
    curvature = np.zeros((len(x), len(x)))
    for (i, j), v in zip(pairs, row[2 + len(x):]):
        curvature[i, j] = curvature[j, i] = v / n
    curvature[np.arange(len(weights)), np.arange(len(weights))] += penalty
    return Certificate(row[1] / n + penalty / 2 * float(w @ w), gradient.tolist(), curvature)


def newton(frame: DataFrame, features: Sequence[Column], label: Column, penalty: float, start: Sequence[float] | None = None,
           exact: float = 1e-10, rounds: int = 30) -> tuple[list[float], float, Certificate]:
    """(weights, intercept, certificate): Newton steps, each one aggregate, until no gradient entry exceeds ``exact``.

    A step that doesn't lower the loss is halved.  For tens of features: the aggregate holds a sum for every pair of them.
    """
    at = np.zeros(len(features) + 1) if start is None else np.array(start, float)
    here = sums_at(frame, features, label, at[:-1], at[-1], penalty)
    for _ in range(rounds):
        if here.steepest <= exact:
            break
        step = np.linalg.lstsq(here.curvature, np.array(here.gradient), rcond=None)[0]
        while True:
            there = sums_at(frame, features, label, (at - step)[:-1], (at - step)[-1], penalty)
            if there.loss <= here.loss + 1e-15 or np.abs(step).max() < 1e-12:
                break
            step = step / 2
        if there.loss > here.loss or there.steepest >= here.steepest and there.loss >= here.loss - 1e-15:
            break
        at, here = at - step, there
    return at[:-1].tolist(), float(at[-1]), here


def certificate(scored: DataFrame, weights: Sequence[float], penalty: float, features: str = "features", label: str = "label", probability: str = "p") -> Certificate:
    """Loss and gradient of a fitted model from its own ``probability`` of class 1, for vectors of any length; one pass.

    The sums stay in Spark's vector summaries, weighted by probability and by label.  The table must have rows.
    """
    inside = F.least(F.greatest(F.col(probability), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -F.when(F.col(label) == 1, F.log(inside)).otherwise(F.log1p(-inside))
    total = lambda w: Summarizer.metrics("sum").summary(F.col(features), w)
    # a summary of weights that are all zero fails, so every label weighs one more, which is taken off again
    row = scored.select(
        total(inside).alias("p"), total(F.col(label) + 1.0).alias("y"), total(F.lit(1.0)).alias("all"),
        F.count(F.lit(1)).alias("n"), F.sum(loss).alias("loss"), F.sum(inside - F.col(label)).alias("free")).first()
    n, w = row["n"], np.array(weights)
    p, y, every = (np.array(row[k]["sum"].toArray()) for k in ("p", "y", "all"))
    gradient = (p - y + every) / n + penalty * w
    return Certificate(row["loss"] / n + penalty / 2 * float(w @ w), [*gradient.tolist(), row["free"] / n])
