"""Ridge regression of any shape.

Up to DIRECT columns, tasks send sums of products and the driver solves one system. Wider ones are
solved by conjugate gradients: a step is one pass over the packed rows that multiplies by the
matrix and its transpose, so no matrix of columns by columns or rows by rows is ever made. A
sketch of the leading directions serves as preconditioner. Targets are solved in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.operators import blocks

#: Columns that are solved directly, numbers of a block of weights, columns of the sketch.
DIRECT, WEIGHTS, SKETCH = 1024, 1 << 22, 64
#: The residual of each target, as a share of its right side, at which the steps end.
TOLERANCE = 1e-10


@dataclass
class Ridge:
    weights: object
    x_mean: object
    x_deviation: object
    y_scale: object
    bias: object
    y_mean: object
    steps: int

    def predict(self, x):
        return (x - self.x_mean) / self.x_deviation @ self.weights * self.y_scale + self.bias


def _directly(held: blocks.Packed, z, t, alpha: float):
    import numpy as np

    gram, right = blocks.summed(held, lambda x, y: [z(x).T @ z(x), z(x).T @ t(y)])
    return np.linalg.solve(gram + alpha * np.eye(held.p), right), 0


def _sketched(held: blocks.Packed, z, alpha: float):
    """The inverse, roughly, of the system: exact in the leading directions that a random sketch of
    one pass finds, and alike in all others."""
    import numpy as np

    k = min(SKETCH, held.p // 2)
    omega = np.linalg.qr(np.random.default_rng(11).normal(size=(held.p, k)))[0]
    image = blocks.summed(held, lambda x, _: [z(x).T @ (z(x) @ omega)])[0]
    shift = np.sqrt(held.p) * np.finfo(float).eps * max(np.linalg.norm(image), 1e-300)
    lower = np.linalg.cholesky(omega.T @ (image + shift * omega) + 1e-300 * np.eye(k))
    u, s, _ = np.linalg.svd(np.linalg.solve(lower, (image + shift * omega).T).T, full_matrices=False)
    values = np.maximum(s**2 - shift, 0)
    least = values[-1] + alpha

    def apply(r):
        inside = u.T @ r
        return r + u @ ((least / (values + alpha) - 1)[:, None] * inside)

    return apply


def _stepwise(held: blocks.Packed, z, t, alpha: float):
    import numpy as np

    precondition, width, solved, steps = _sketched(held, z, alpha), max(1, WEIGHTS // held.p), [], 0
    for first in range(0, held.q, width):
        own = slice(first, first + width)
        right = blocks.summed(held, lambda x, y, own=own: [z(x).T @ t(y)[:, own]])[0]
        w, residual = np.zeros_like(right), right
        ahead = direction = precondition(residual)
        size = (residual * ahead).sum(axis=0)
        bound = TOLERANCE * np.maximum(np.linalg.norm(right, axis=0), 1e-300)
        for _ in range(10 * min(held.p, held.rows) + 100):
            if (np.linalg.norm(residual, axis=0) <= bound).all():
                break
            image = blocks.summed(held, lambda x, _, d=direction: [z(x).T @ (z(x) @ d)])[0] + alpha * direction
            length = size / np.maximum((direction * image).sum(axis=0), 1e-300)
            w, residual, steps = w + length * direction, residual - length * image, steps + 1
            ahead = precondition(residual)
            former, size = size, (residual * ahead).sum(axis=0)
            direction = ahead + size / np.maximum(former, 1e-300) * direction
        else:
            raise RuntimeError("the steps did not settle")
        solved.append(w)
    return np.concatenate(solved, axis=1), steps


def fit_ridge(train: DataFrame, x: str | Column = "x", y: str | Column = "y", alpha: float = 1.0, standardize_y: bool = True) -> Ridge:
    """Weights for standardised columns of ``x`` (deviations under 1e-6 taken as 1), and a bias
    column that is penalised as well: it is 0 for standardised targets, and for others their mean
    times n / (n + alpha). Without rows this is an error; ``alpha`` must be above 0."""
    held = blocks.packed(train, x, y)
    if not held.rows:
        raise ValueError("no train rows")
    (x_mean, x_deviation), (y_mean, y_deviation) = blocks.scaler(held)
    scale = y_deviation if standardize_y else y_deviation * 0 + 1
    z = lambda x: (x - x_mean) / x_deviation
    t = lambda y: (y - y_mean) / scale
    weights, steps = (_directly if held.p <= DIRECT else _stepwise)(held, z, t, alpha)
    bias = y_mean if standardize_y else y_mean * held.rows / (held.rows + alpha)
    return Ridge(weights, x_mean, x_deviation, scale, bias, y_mean, steps)


def ridge_scores(model: Ridge, test: DataFrame, x: str = "x") -> DataFrame:
    """``test`` with predicted, an array of all targets; null where ``x`` is."""
    return blocks.mapped(test, x, lambda m: [list(model.predict(m))], "predicted array<double>")


def standard_scores(model: Ridge, test: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``test`` with predicted and vector, the prediction and ``y`` both in the targets' standard
    scale of the train rows."""

    def predict(m):
        return [list((model.predict(m) - model.y_mean) / model.y_scale)]

    both = blocks.mapped(test, x, predict, "predicted array<double>")
    lit = lambda v: F.array(*map(F.lit, map(float, v)))
    moved = F.zip_with(y, lit(model.y_mean), lambda a, b: a - b)
    return both.withColumn("vector", F.zip_with(moved, lit(model.y_scale), lambda a, b: a / b))


def ridge_predict(train: DataFrame, test: DataFrame, x: str = "x", y: str | Column = "y", alpha: float = 1.0, standardize_y: bool = True) -> DataFrame:
    """Fit on ``train`` and predict ``test``; null predictions if ``train`` has no rows."""
    if train.isEmpty():
        return test.withColumn("predicted", F.lit(None).cast("array<double>"))
    return ridge_scores(fit_ridge(train, x, y, alpha, standardize_y), test, x)


def ridge_classify(train: DataFrame, test: DataFrame, classes: int, x: str = "x", label: str = "label", alpha: float = 1.0) -> DataFrame:
    """``test`` with predicted: the class whose one-hot target ridge regression rates highest, the
    smallest of equals."""
    hot = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: (F.col(label) == k).cast("double"))
    made = ridge_predict(train, test, x, hot, alpha, standardize_y=False)
    best = F.array_max(F.transform("predicted", lambda v, k: F.struct(v.alias("v"), (-k).alias("k"))))
    return made.withColumn("predicted", -best["k"])
