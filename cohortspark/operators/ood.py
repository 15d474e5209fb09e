"""Out-of-distribution screening."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.numeric import to_double
from cohortspark.operators.quantile import exact_quantile
from cohortspark.schema import OOD_COLS

# Std floor (package), zero-std replacement (notebook), flag thresholds.
STD_FLOOR = 1e-12
NOTEBOOK_ZERO_STD = 1.0
WARN_THRESH = 2.0
CRIT_THRESH = 3.0
# The train quantile beyond which a Mahalanobis distance counts as out of distribution.
MAHALANOBIS_QUANTILE = 0.99


def fit_ood_stats(df_train: DataFrame, cols: Sequence[str] = OOD_COLS, *,
                  variant: str = "package") -> DataFrame:
    """Long stats table ``(col, mean, std)`` from one aggregate pass.

    package: population std, std < 1e-12 or non-finite → 1e-12.
    notebook: sample std, std == 0 → 1.0 (fit on whatever rows are passed).
    """
    missing = [c for c in cols if c not in df_train.columns]
    if missing:
        raise KeyError(f"the rows to fit on lack {missing}")
    aggs = []
    for i, c in enumerate(cols):
        x = to_double(F.col(f"`{c}`"))
        std = F.stddev_pop(x) if variant == "package" else F.stddev_samp(x)
        aggs += [F.avg(x).alias(f"m{i}"), std.alias(f"s{i}")]
    wide = df_train.agg(*aggs)
    rows = []
    for i, c in enumerate(cols):
        s = F.col(f"s{i}")
        if variant == "package":
            s = F.when(s.isNull() | F.isnan(s) | (F.abs(s) == F.lit(float("inf"))) |
                       (s < F.lit(STD_FLOOR)), F.lit(STD_FLOOR)).otherwise(s)
        else:
            s = F.when(s.isNull() | F.isnan(s) | (s == 0), F.lit(NOTEBOOK_ZERO_STD)).otherwise(s)
        rows.append(F.struct(F.lit(c).alias("col"), F.col(f"m{i}").alias("mean"), s.alias("std")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def score_ood(df: DataFrame, stats: DataFrame, cols: Sequence[str] = OOD_COLS, *,
              score_col: str = "ood_score") -> DataFrame:
    """Max |z| over ``cols``; a null value counts as the mean (z = 0).

    ``stats`` has one row per column (k rows); they are fetched once and
    folded into the plan as literals, so scoring is a pure projection (no
    join, works unchanged on streams).
    """
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"the rows to score lack {missing}")
    got = {r["col"]: (r["mean"], r["std"]) for r in stats.where(F.col("col").isin(*cols)).collect()}
    if any(c not in got for c in cols):
        raise KeyError(f"OOD stats lack columns: {[c for c in cols if c not in got]}")
    if any(got[c][0] is None for c in cols):
        # An undefined training mean makes the reference's score NaN, later read as 0.
        return df.withColumn(score_col, F.lit(None).cast("double"))
    zs = []
    for c in cols:
        m, s = float(got[c][0]), float(got[c][1])
        zs.append(F.abs((F.coalesce(to_double(F.col(f"`{c}`")), F.lit(m)) - F.lit(m)) / F.lit(s)))
    return df.withColumn(score_col, F.array_max(F.array(*zs)))


def flag_ood(df: DataFrame, *, score_col: str = "ood_score", warn_thresh: float = WARN_THRESH,
             crit_thresh: float = CRIT_THRESH) -> DataFrame:
    s = F.coalesce(F.col(score_col), F.lit(0.0))
    s = F.when(F.isnan(s), F.lit(0.0)).otherwise(s)
    return df.withColumns({score_col: s, "ood_warn": s >= F.lit(warn_thresh),
                           "ood_crit": s >= F.lit(crit_thresh)})


def flag_counts(df_flagged: DataFrame) -> DataFrame:
    return df_flagged.agg(F.count_if("ood_warn").alias("n_warn"),
                          F.count_if("ood_crit").alias("n_crit"),
                          F.count(F.lit(1)).alias("n_rows"))


# --- notebook variant: Mahalanobis distance -------------------------------------------

def fit_mahalanobis(df_train: DataFrame, cols: Sequence[str] = OOD_COLS) -> dict:
    """Mean vector and inverse sample covariance from one aggregate pass.

    The k×k covariance (k = number of columns, small and fixed) is reduced on
    the executors; only the k² numbers reach the driver for the inversion.
    """
    k = len(cols)
    xs = [to_double(F.col(f"`{c}`")) for c in cols]
    aggs = [F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)]
    aggs += [F.covar_samp(xs[i], xs[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    r = df_train.agg(*aggs).first()
    mean = np.array([r[f"m{i}"] for i in range(k)], dtype=float)
    cov = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            v = r[f"c{i}_{j}"]
            cov[i, j] = cov[j, i] = 0.0 if v is None else v
    icov = np.linalg.pinv(cov)
    return {"cols": list(cols), "mean": mean.tolist(), "icov": icov.tolist()}


def mahalanobis(df: DataFrame, model: dict, *, out_col: str = "mahalanobis") -> DataFrame:
    """sqrt((x-μ)ᵀ S⁻¹ (x-μ)) as a k² literal-coefficient expression (nulls → mean)."""
    cols, mean, icov = model["cols"], model["mean"], model["icov"]
    d = [F.coalesce(to_double(F.col(f"`{c}`")), F.lit(mean[i])) - F.lit(mean[i])
         for i, c in enumerate(cols)]
    q = F.lit(0.0)
    for i in range(len(cols)):
        for j in range(len(cols)):
            q = q + d[i] * F.lit(float(icov[i][j])) * d[j]
    return df.withColumn(out_col, F.sqrt(F.greatest(q, F.lit(0.0))))


def fit_mahalanobis_threshold(df_train: DataFrame, model: dict, q: float = MAHALANOBIS_QUANTILE) -> dict:
    """The model with ``threshold``: the exact ``q`` quantile of the train distances."""
    return {**model, "threshold": exact_quantile(mahalanobis(df_train, model, out_col="_d"), "_d", q)}


def check_mahalanobis(df: DataFrame, model: dict, *, out_col: str = "mahalanobis", flag_col: str = "is_ood") -> DataFrame:
    """Distance and whether it passes the threshold."""
    return mahalanobis(df, model, out_col=out_col).withColumn(flag_col, F.col(out_col) > F.lit(model["threshold"]))
