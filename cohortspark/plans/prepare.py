"""Shared front of every job: raw trials → cleaned → geography → split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortspark.operators.clean import clean_trials
from cohortspark.operators.geo import derive_geography
from cohortspark.operators.split import assign_split
from cohortspark.sources.trials_view import trials_view


def cleaned_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial view → clean (batch medians, reference behaviour) → geography counts."""
    return derive_geography(clean_trials(trials_view(spark, sf_dir)))


def split_trials(spark: SparkSession, sf_dir: str, **split_kwargs) -> DataFrame:
    return assign_split(cleaned_trials(spark, sf_dir), key_col="nct_id", **split_kwargs)
