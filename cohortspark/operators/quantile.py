"""Exact quantiles of one numeric column without sorting it.

The values' range is cut into equal buckets and counted; only the bucket that
holds the wanted rank is looked at again, and cut anew until it is small or
holds a single value. Each pass reads the column once and returns one row per bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
FEW = 10_000  # values of a bucket that may be sorted in one task


def _value_at(rows: DataFrame, rank: int, n: int) -> float:
    """The value with ``rank`` (from 0) among the ``n`` non-null values ``v``."""
    while True:
        if n <= FEW:
            return rows.orderBy("v").limit(rank + 1).agg(F.max("v")).first()[0]
        lo, hi = rows.agg(F.min("v"), F.max("v")).first()
        if lo == hi:
            return lo
        width = (hi - lo) / BUCKETS
        bucket = F.least(F.floor((F.col("v") - lo) / width), F.lit(BUCKETS - 1)) if width > 0 and math.isfinite(width) else (F.col("v") > lo).cast("long")
        counts = rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
        for c in counts:
            if rank < c["n"]:
                rows, n = rows.where(F.col("v").between(c["lo"], c["hi"])), c["n"]
                break
            rank -= c["n"]
        if c["lo"] == c["hi"]:
            return c["lo"]


def exact_quantile(df: DataFrame, column: str, q: float) -> float | None:
    """The ``q`` quantile with linear interpolation between the two nearest ranks; null and NaN values do not count."""
    if not 0 <= q <= 1:
        raise ValueError("q must lie between 0 and 1")
    v = F.col(f"`{column}`").cast("double")
    rows = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    n = rows.count()
    if not n:
        return None
    at = q * (n - 1)
    low = math.floor(at)
    a = _value_at(rows, low, n)
    if at == low:
        return float(a)
    b = _value_at(rows, low + 1, n)
    return float(a + (b - a) * (at - low))
