"""Column expressions over arrays of numbers, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def doubles(v: Column) -> Column:
    """The components as doubles."""
    return v.cast("array<double>")


def total(v: Column) -> Column:
    """Sum of the components, added in order."""
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Scalar product."""
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(v, v))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine."""
    return 1.0 - dot(a, b) / (norm(a) * norm(b))


def squared_distance(a: Column, b: Column) -> Column:
    """Square of the Euclidean distance."""
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(squared_distance(a, b))


def rbf(a: Column, b: Column, gamma: float) -> Column:
    """Radial basis kernel."""
    return F.exp(-gamma * squared_distance(a, b))


def scaled(v: Column, by: Column) -> Column:
    """Components divided by a number."""
    return F.transform(doubles(v), lambda x: x / by)


def unit(v: Column) -> Column:
    """Vector of length 1 in the same direction; a zero vector stays."""
    return F.when(norm(v) == 0, doubles(v)).otherwise(scaled(v, norm(v)))


def unit_under_root(v: Column, added: float = 0.01) -> Column:
    """Vector divided by the root of its squared length plus ``added``: for region descriptors."""
    return scaled(v, F.sqrt(dot(v, v) + added))


def unit_with_epsilon(v: Column, epsilon: float = 0.0) -> Column:
    """Vector divided by its length plus ``epsilon``: for cells of feature maps. Null for a zero divisor."""
    return F.when(norm(v) + epsilon != 0, scaled(v, norm(v) + epsilon))


def all_close(a: Column, b: Column, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    """Whether all components agree: abs(a - b) <= absolute + relative * abs(b)."""
    return F.forall(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y) <= absolute + relative * F.abs(y)), lambda ok: F.coalesce(ok, F.lit(False)))


def quantize(v: Column, low: Column, high: Column) -> Column:
    """Bytes 0 to 255 between ``low`` and ``high``; the range 0 counts as 1. Rounds half to even."""
    spread = F.when(high == low, 1.0).otherwise(high - low)
    return F.transform(doubles(v), lambda x: F.bround((x - low) / spread * 255.0).cast("int"))


def dequantize(q: Column, low: Column, high: Column) -> Column:
    """Values of the bytes of ``quantize``."""
    spread = F.when(high == low, 1.0).otherwise(high - low)
    return F.transform(q, lambda x: x / 255.0 * spread + low)


def sparse_places(v: Column) -> Column:
    """Places (from 0) of the components that are not zero."""
    return F.filter(F.transform(v, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())


def deltas(places: Column) -> Column:
    """Differences of ascending places, the first from 0."""
    return F.transform(places, lambda x, i: x - F.when(i == 0, 0).otherwise(F.try_element_at(places, i)))


def delta_width(gaps: Column) -> Column:
    """Bits that hold the differences: 8, 16 or 32; null for none."""
    top = F.array_max(gaps)
    return F.when(top <= 255, 8).when(top <= 65535, 16).when(top.isNotNull(), 32)
