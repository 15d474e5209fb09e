"""The attribution job. Four sorted tables from one materialised pass, published together."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.operators import attribution as A
from cohortspark.operators.ranking import global_rank
from cohortspark.session import checkpoint_dir
from cohortspark.sources.writers import publish_tables


def attribution_tables(long: DataFrame, features: DataFrame, targets: Sequence[str], n_rows: int, group: Column, *, top: int = 50) -> dict[str, DataFrame]:
    """The job's tables, each with its ``rank``.

    ``long`` is a (sparse) attribution table (key, target, feature, value) of ``n_rows`` rows, ``features`` all
    features of the model (one column ``feature``), ``group`` an expression over ``feature``. Features, groups and
    (group, target) cells without a value are there with 0. The long table is read once: its means by target and feature are written first.
    """
    spark = long.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"mean-abs-{uuid.uuid4().hex}")
    A.mean_abs_by_target(long, n_rows).write.parquet(path)
    by_target = spark.read.parquet(path)
    glob = A.global_importance(by_target, len(targets), features)
    ranked = global_rank(glob, F.desc("mean_abs_shap"), "feature")
    mass = A.group_mass(glob, group).select("group", F.col("mean_abs_shap_sum").alias("aggregated_shap_mass"), "n_features", F.col("mean_abs_shap_per_feature").alias("mean_per_feature"))
    by_group = A.group_by_target(by_target, group, features, targets)
    return {
        "mean_abs_per_feature": ranked.select("rank", "feature", "mean_abs_shap"),
        "group_mass": global_rank(mass, F.desc("aggregated_shap_mass"), "group").select("rank", "group", "aggregated_shap_mass", "n_features", "mean_per_feature"),
        "top_structured_features": global_rank(A.top_structured(glob, top), F.desc("mean_abs_shap"), "feature").select("rank", "feature", "mean_abs_shap"),
        "group_by_target": global_rank(by_group, "group", "target").select("rank", "group", "target", "sum_mean_abs_shap"),
    }


def run_attribution_job(long: DataFrame, features: DataFrame, targets: Sequence[str], n_rows: int, group: Column, out_dir: str, *, top: int = 50) -> str:
    """Write the tables as CSV and publish them by a manifest; returns the run's name."""
    return publish_tables(attribution_tables(long, features, targets, n_rows, group, top=top), out_dir)
