"""Split, fit OOD stats on train, score every row, flag, count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.ood import fit_ood_stats, flag_ood, score_ood
from cohortspark.schema import OOD_COLS


def ood_report(df_split: DataFrame, cols: Sequence[str] = OOD_COLS, *,
               warn_thresh: float = 2.0, crit_thresh: float = 3.0) -> DataFrame:
    """``df_split`` carries a ``split`` column; stats come from its train rows."""
    stats = fit_ood_stats(df_split.where(F.col("split") == "train"), cols)
    scored = score_ood(df_split, stats, cols)
    return flag_ood(scored, warn_thresh=warn_thresh, crit_thresh=crit_thresh)
