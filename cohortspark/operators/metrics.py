"""Per-target error tables (A5-A9, M21, J9): RMSE / MAE per split and target.

Truth and prediction stay on the same row, so a metric table is one
aggregate keyed by split (a handful of groups; partial aggregation makes
the shuffle a few rows per task regardless of skew), unpivoted afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.numeric import clip01, to_double

SPLIT_ORDER = ["train", "test", "holdout"]


def extract_targets(df: DataFrame, target_cols: Sequence[str], *, null_targets: str = "zero",
                    prefix: str = "") -> DataFrame:
    """P10: coerce to double, null → 0 (``null_targets="zero"``), clip to [0, 1]."""
    missing = [t for t in target_cols if t not in df.columns]
    if missing:
        raise KeyError(f"Missing target columns: {missing}")
    out = {}
    for t in target_cols:
        y = to_double(F.col(f"`{t}`"))
        if null_targets == "zero":
            y = F.coalesce(y, F.lit(0.0))
        out[prefix + t] = clip01(y)
    return df.withColumns(out)


def metrics_long(df: DataFrame, target_cols: Sequence[str], pred_cols: Sequence[str], *,
                 split_col: str | None = "split", clip: bool = True,
                 target_names: Sequence[str] | None = None) -> DataFrame:
    """``(split, target, rmse, mae, n)``; both sides clipped to [0, 1] when ``clip``.

    ``target_names`` labels the rows (P23: ``target_i`` when none are given
    and the columns carry no usable names, i.e. ``target_names=[]``).
    """
    if len(target_cols) != len(pred_cols):
        raise ValueError("target and prediction column lists differ in length")
    if target_names is not None and len(target_names) == 0:
        target_names = [f"target_{i}" for i in range(len(target_cols))]
    if target_names is not None and len(target_names) != len(target_cols):
        raise ValueError(f"{len(target_names)} names for {len(target_cols)} targets")
    aggs = []
    for i, (t, p) in enumerate(zip(target_cols, pred_cols)):
        y, yh = F.col(f"`{t}`"), F.col(f"`{p}`")
        if clip:
            y, yh = clip01(y), clip01(yh)
        d = y - yh
        aggs += [F.sqrt(F.avg(d * d)).alias(f"r{i}"), F.avg(F.abs(d)).alias(f"a{i}")]
    keys = [split_col] if split_col else []
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs)
    labels = list(target_names) if target_names is not None else list(target_cols)
    rows = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"r{i}").alias("rmse"),
                              F.col(f"a{i}").alias("mae")) for i, t in enumerate(labels)])
    return per.select(*keys, "n", F.inline(rows))


def metrics_table(long: DataFrame, *, split_col: str = "split") -> DataFrame:
    """Target | Train RMSE | Train MAE | Test RMSE | Test MAE | Holdout RMSE | Holdout MAE."""
    wide = (long.groupBy("target").pivot(split_col, SPLIT_ORDER)
            .agg(F.first("rmse").alias("rmse"), F.first("mae").alias("mae")))
    cols = [F.col("target").alias("Target")]
    for s in SPLIT_ORDER:
        cols += [F.col(f"{s}_rmse").alias(f"{s.capitalize()} RMSE"),
                 F.col(f"{s}_mae").alias(f"{s.capitalize()} MAE")]
    return wide.select(*cols)


def macro_rmse(long: DataFrame, *, split_col: str = "split") -> DataFrame:
    """Mean RMSE and MAE over targets, per split."""
    return long.groupBy(split_col).agg(F.avg("rmse").alias("macro_rmse"),
                                       F.avg("mae").alias("macro_mae"))
