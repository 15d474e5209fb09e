"""The trial cleaning job as ``fit_clean`` (one aggregate) + ``apply_clean`` (one select)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.age import with_parsed_ages
from cohortspark.functions.categorical import normalize_categorical, normalize_text
from cohortspark.schema import CAT_COLS, TEXT_COLS, UNKNOWN_TOKEN, find_column_ci, last_spelling

# Imputation fallbacks for an all-missing age column, clamp range.
MIN_AGE_FALLBACK = 0.0
MAX_AGE_FALLBACK = 100.0
AGE_CLAMP = (0.0, 120.0)


@dataclass(frozen=True)
class CleanStats:
    """Frozen imputation values (persisted with artifacts for stream scoring)."""
    min_age_median: float
    max_age_median: float


def _age_columns(df: DataFrame, min_age_col: str, max_age_col: str) -> tuple[str, str]:
    lo, hi = find_column_ci(df, min_age_col), find_column_ci(df, max_age_col)
    if not lo or not hi:
        raise KeyError(f"no age columns like {min_age_col!r} and {max_age_col!r} among {df.columns}")
    return lo, hi


def with_parsed(df: DataFrame, min_age_col: str = "eligibility_min_age",
                max_age_col: str = "eligibility_max_age", variant: str = "package") -> DataFrame:
    """Add ``_pmin`` / ``_pmax``: parsed years before imputation."""
    df = last_spelling(df)
    lo, hi = _age_columns(df, min_age_col, max_age_col)
    return with_parsed_ages(df, {"_pmin": lo, "_pmax": hi}, variant)


def fit_clean(df: DataFrame, *, min_age_col: str = "eligibility_min_age",
              max_age_col: str = "eligibility_max_age", median: str = "exact",
              variant: str = "package") -> CleanStats:
    """Medians of the parsed ages (nulls skipped), in one aggregate job.

    ``median="exact"`` uses Spark's exact percentile, whose buffer holds one
    entry per *distinct* value (ages have a small domain); ``"approx"`` uses
    ``percentile_approx`` for columns with unbounded distinct counts.
    """
    agg = F.median if median == "exact" else (lambda c: F.percentile_approx(c, 0.5, 100000))
    row = with_parsed(df, min_age_col, max_age_col, variant).agg(
        agg("_pmin").alias("lo"), agg("_pmax").alias("hi")).first()
    lo = MIN_AGE_FALLBACK if row["lo"] is None else float(row["lo"])
    hi = MAX_AGE_FALLBACK if row["hi"] is None else float(row["hi"])
    return CleanStats(lo, hi)


def apply_clean(df: DataFrame, stats: CleanStats, *, min_age_col: str = "eligibility_min_age",
                max_age_col: str = "eligibility_max_age", cat_cols: Sequence[str] = CAT_COLS,
                text_cols: Sequence[str] = TEXT_COLS, unknown_token: str = UNKNOWN_TOKEN,
                clamp: bool = True, swap: bool = True, variant: str = "package") -> DataFrame:
    """Parse → flag → impute → clamp → order ages; normalise categories and texts.

    A narrow projection: no shuffle, same plan on a batch or a stream.
    Emits the age columns under their input names and as ``*_yrs``.
    """
    df = last_spelling(df)
    lo_name, hi_name = _age_columns(df, min_age_col, max_age_col)
    df = with_parsed(df, min_age_col, max_age_col, variant)
    pmin, pmax = F.col("_pmin"), F.col("_pmax")
    lo = F.coalesce(pmin, F.lit(stats.min_age_median))
    hi = F.coalesce(pmax, F.lit(stats.max_age_median))
    if clamp:
        lo = F.least(F.greatest(lo, F.lit(AGE_CLAMP[0])), F.lit(AGE_CLAMP[1]))
        hi = F.least(F.greatest(hi, F.lit(AGE_CLAMP[0])), F.lit(AGE_CLAMP[1]))
    if swap:
        lo, hi = F.least(lo, hi), F.greatest(lo, hi)
    new_cols = {
        lo_name: lo, hi_name: hi,
        "min_age_missing": pmin.isNull().cast("int"),
        "max_age_missing": pmax.isNull().cast("int"),
    }
    for c in cat_cols:
        new_cols[c] = (normalize_categorical(F.col(f"`{c}`"), unknown_token, variant)
                       if c in df.columns else F.lit(unknown_token))
    for c in text_cols:
        new_cols[c] = normalize_text(F.col(f"`{c}`")) if c in df.columns else F.lit("")
    out = df.withColumns(new_cols).drop("_pmin", "_pmax")
    return out.withColumns({"eligibility_min_age_yrs": F.col(f"`{lo_name}`"),
                            "eligibility_max_age_yrs": F.col(f"`{hi_name}`")})


def clean_trials(df: DataFrame, *, stats: CleanStats | None = None, **kwargs) -> DataFrame:
    """Whole cleaning job. Without ``stats`` the medians come from this batch
    (reference behaviour); pass frozen ``stats`` for scoring and streams."""
    if stats is None:
        stats = fit_clean(df, min_age_col=kwargs.get("min_age_col", "eligibility_min_age"),
                          max_age_col=kwargs.get("max_age_col", "eligibility_max_age"))
    return apply_clean(df, stats, **kwargs)


clean_missing = clean_trials
