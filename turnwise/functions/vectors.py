"""Vector expressions over ``array<float|double>`` columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms below this count as this, so that a zero vector stays one.
TINY = 1e-12
# Weights of the selected image, the others shown, and the text, in the feedback update.
ALPHA, BETA, GAMMA = 0.08, 0.29, 0.44


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def _once(value: Column, then) -> Column:
    """``then(value)``, with ``value`` worked out once and not for each element of an array."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def normalised(v: Column) -> Column:
    scaled = lambda w: _once(F.greatest(norm(w), F.lit(TINY)), lambda n: F.transform(w, lambda x: x.cast("double") / n))
    return _once(v, scaled)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(TINY)) * F.greatest(norm(b), F.lit(TINY)))


def add_scaled(a: Column, b: Column, scale: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * F.lit(scale))


def mean_of(vectors: Column) -> Column:
    """Element-wise mean of an array of vectors; null if there is none."""
    return _once(vectors, _mean)


def _mean(vectors: Column) -> Column:
    n = F.size(vectors)
    first = F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double"))
    total = F.aggregate(F.slice(vectors, 2, F.greatest(n - 1, F.lit(0))), first, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.when(n > 0, F.transform(total, lambda x: x / n))


def feedback(query: Column, text: Column, selected: Column, others_mean: Column, alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA) -> Column:
    """The moved query: normalised (q + gamma t + alpha s - beta mean of the others), all but the mean of unit length."""
    moved = add_scaled(add_scaled(normalised(query), normalised(text), gamma), normalised(selected), alpha)
    pulled = F.when(others_mean.isNull(), moved).otherwise(add_scaled(moved, others_mean, -beta))
    return normalised(pulled)
