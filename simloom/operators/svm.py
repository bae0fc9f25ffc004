"""Kernel machines fitted on the few examples of a query.

The examples are part of the request, so the dual problem is solved on the
driver; what comes out, one coefficient for each example and a constant, scores
any number of rows in an Arrow function.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf


@dataclass
class Machine:
    """Scores a vector x by sum of coefficient * kernel(x, example), less ``offset``."""

    examples: np.ndarray
    coefficients: np.ndarray
    offset: float
    gamma: float

    def score(self, v: Column) -> Column:
        """The score of a column of vectors: one Arrow function that holds the examples; null where the vector is."""
        used = self.coefficients != 0
        examples, coefficients, offset, gamma = self.examples[used], self.coefficients[used], self.offset, self.gamma

        @arrow_udf("double")
        def scored(vectors: pa.Array) -> pa.Array:
            out, known = np.full(len(vectors), np.nan), np.asarray(vectors.is_valid())
            some = vectors.drop_null()
            if len(some):
                x = some.flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1)
                total = np.full(len(x), -offset)
                for e, c in zip(examples, coefficients, strict=True):
                    total += c * np.exp(-gamma * ((x - e) ** 2).sum(axis=1))
                out[known] = total
            return pa.array(out, mask=~known)

        return scored(v.cast("array<double>"))


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    """Radial basis kernel of two sets of rows."""
    return np.exp(-gamma * ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def _solve(q: np.ndarray, p: np.ndarray, y: np.ndarray, top: float, a: np.ndarray, rounds: int = 100_000, tolerance: float = 1e-10) -> np.ndarray:
    """Minimise a'qa/2 + p'a for 0 <= a <= top and constant y'a, moving the pair that violates the conditions most."""
    g = q @ a + p
    for _ in range(rounds):
        up = ((y > 0) & (a < top)) | ((y < 0) & (a > 0))
        down = ((y > 0) & (a > 0)) | ((y < 0) & (a < top))
        if not up.any() or not down.any():
            break
        v = -y * g
        i, j = np.flatnonzero(up)[v[up].argmax()], np.flatnonzero(down)[v[down].argmin()]
        if v[i] - v[j] < tolerance:
            break
        bend = max(q[i, i] + q[j, j] - 2 * y[i] * y[j] * q[i, j], 1e-12)
        t = (v[i] - v[j]) / bend
        t = min(t, top - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else top - a[j])
        a[i] += y[i] * t
        a[j] -= y[j] * t
        g += q[:, i] * (y[i] * t) - q[:, j] * (y[j] * t)
    return a


def _middle(values: np.ndarray, a: np.ndarray, top: float, y: np.ndarray) -> float:
    """The constant of the decision: mean over free examples, else the middle of what the others allow."""
    free = (a > 1e-12) & (a < top - 1e-12)
    if free.any():
        return float(values[free].mean())
    up = ((y > 0) & (a <= 1e-12)) | ((y < 0) & (a >= top - 1e-12))
    high, low = values[~up], values[up]
    if not len(high) or not len(low):
        return float((high if len(high) else low).max() if len(high) else low.min())
    return float((high.max() + low.min()) / 2)


def one_class(positives: np.ndarray, gamma: float = 1.0, nu: float = 0.5) -> Machine:
    """One-class machine; the coefficients are scaled to the sum nu * n."""
    n = len(positives)
    k = kernel(positives, positives, gamma)
    a = np.zeros(n)
    whole = int(nu * n)
    a[:whole] = 1.0
    if whole < n:
        a[whole] = nu * n - whole
    a = _solve(k, np.zeros(n), np.ones(n), 1.0, a)
    g = k @ a
    free = (a > 1e-12) & (a < 1 - 1e-12)
    if free.any():
        rho = float(g[free].mean())
    else:
        inner, outer = g[a >= 1 - 1e-12], g[a <= 1e-12]
        rho = float((inner.max() + outer.min()) / 2) if len(inner) and len(outer) else float(inner.max() if len(inner) else outer.min())
    return Machine(positives, a, rho, gamma)


def two_class(positives: np.ndarray, negatives: np.ndarray, gamma: float = 2.0, cost: float = 1.0) -> Machine:
    """Soft-margin machine; positive scores are for the side of the positives."""
    x = np.concatenate([positives, negatives])
    y = np.concatenate([np.ones(len(positives)), -np.ones(len(negatives))])
    k = kernel(x, x, gamma)
    a = _solve(k * np.outer(y, y), -np.ones(len(x)), y, cost, np.zeros(len(x)))
    return Machine(x, a * y, _middle(k @ (a * y) - y, a, cost, y), gamma)
