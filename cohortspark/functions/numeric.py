"""Numeric helpers: NaN handling, clipping, sigmoid, z-scores, vector algebra on arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    d = c.cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def to_double(col: Column | str) -> Column:
    """Numeric coercion: non-numbers and NaN become null (never raises under ANSI)."""
    c = F.col(col) if isinstance(col, str) else col
    return nan_to_null(c.try_cast("double"))


def clip(c: Column, lo: float, hi: float) -> Column:
    """np.clip with NaN kept as NaN and null kept as null."""
    return F.when(c.isNull() | F.isnan(c), c).otherwise(F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def clip01(c: Column) -> Column:
    return clip(c, 0.0, 1.0)


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def max_abs_z(cols: Sequence[Column], means: Sequence[Column], stds: Sequence[Column]) -> Column:
    """max_j |(x_j - m_j) / s_j| (skips null terms)."""
    zs = [F.abs((x - m) / s) for x, m, s in zip(cols, means, stds)]
    return F.array_max(F.array(*zs))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector gives similarity 0."""
    return F.coalesce(F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b)), F.lit(0.0))


def l2_normalize(a: Column, floor: float = 1e-12) -> Column:
    n = F.greatest(l2_norm(a), F.lit(floor))
    return F.transform(a, lambda v: v.cast("double") / n)


def as_percent(c: Column, digits: int = 2) -> Column:
    """share → percent rounded for display."""
    return F.round(c * F.lit(100.0), digits)
