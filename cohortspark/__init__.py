"""cohortspark: a PySpark-native engine for trial-level enrolment modelling.

Cleaning, geography, deterministic key splits, one-hot / text features,
Spark ML models (multi-target and hurdle), frozen-artifact scoring on
batches and streams, metric tables, baselines, attributions and OOD flags.
"""

from cohortspark.operators.attribution import global_importance, mean_abs_by_target
from cohortspark.operators.clean import CleanStats, apply_clean, clean_trials, fit_clean
from cohortspark.operators.embed import TextEncoder, register_encoder, text_embedding
from cohortspark.operators.features import assemble_features, encode_categoricals, fit_categorical_encoder, numeric_block
from cohortspark.operators.geo import derive_geography, geo_guardrails
from cohortspark.operators.hurdle import HurdleModel, hurdle_combine, sex_renormalize
from cohortspark.operators.joins import audit_predictions, join_blocks
from cohortspark.operators.metrics import extract_targets, metrics_long, metrics_table
from cohortspark.operators.multiboost import BoostModel, Member, fit_members, staged_errors
from cohortspark.operators.ood import fit_ood_stats, flag_ood, score_ood
from cohortspark.operators.scoring import predict_from_artifacts, score_frame
from cohortspark.operators.split import assign_split, sample_n, split_dataframe
from cohortspark.operators.tuning import tpe_search
from cohortspark.plans.train import Factories, TrainOutputs, score_with_artifacts, train_pipeline
from cohortspark.schema import (
    CAT_COLS, NUMERIC_COLS, OOD_COLS, SPARSE_TARGETS, TARGET_COLS, TEXT_COLS, validate_schema,
)
from cohortspark.session import checkpoint_dir, get_spark
from cohortspark.sources.artifacts import Artifacts, load_artifacts, save_artifacts
from cohortspark.sources.readers import load_dataframe
from cohortspark.sources.writers import save_dataframe

__all__ = [
    "Artifacts", "BoostModel", "CAT_COLS", "CleanStats", "Factories", "HurdleModel", "Member", "NUMERIC_COLS", "OOD_COLS", "SPARSE_TARGETS",
    "TARGET_COLS", "TEXT_COLS", "TextEncoder", "TrainOutputs", "apply_clean", "assemble_features", "assign_split", "audit_predictions",
    "checkpoint_dir", "clean_trials", "derive_geography", "encode_categoricals", "extract_targets", "fit_categorical_encoder", "fit_clean",
    "fit_members", "fit_ood_stats", "flag_ood", "geo_guardrails", "get_spark", "global_importance", "hurdle_combine", "join_blocks",
    "load_artifacts", "load_dataframe", "mean_abs_by_target", "metrics_long", "metrics_table", "numeric_block", "predict_from_artifacts",
    "register_encoder", "sample_n", "save_artifacts", "save_dataframe", "score_frame", "score_ood", "score_with_artifacts", "sex_renormalize",
    "split_dataframe", "staged_errors", "text_embedding", "tpe_search", "train_pipeline", "validate_schema",
]
