"""M22 training job and M25 / M21 / M26 scoring, evaluation and baseline jobs."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.baselines import mean_baseline, union_baselines
from cohortspark.operators.clean import CleanStats, apply_clean, fit_clean
from cohortspark.operators.features import cat_feature_names, fit_categorical_encoder
from cohortspark.operators.geo import derive_geography, numeric_guardrails
from cohortspark.operators.metrics import extract_targets, metrics_long, metrics_table
from cohortspark.operators.models import (
    HURDLE_PRESET, MAIN_PRESET, STRUCTURED_PRESET, fit_all, fit_vector, predict_multitarget,
)
from cohortspark.operators.neighbors import knn_mean_targets, knn_neighbors
from cohortspark.operators.embed import DEFAULT_DIM, HASHING, TextEncoder, register_encoder
from cohortspark.operators.ood import fit_ood_stats
from cohortspark.operators.scoring import PRED_PREFIX, build_features, predict_from_artifacts, score_frame
from cohortspark.operators.split import assign_split
from cohortspark.schema import (
    CAT_COLS, NUMERIC_COLS, OOD_COLS, SPARSE_TARGETS, TEXT_COLS, validate_schema,
)
from cohortspark.session import checkpoint_dir
from cohortspark.sources.artifacts import Artifacts, build_schema_manifest, load_artifacts, save_artifacts


@dataclass
class TrainOutputs:
    artifacts: Artifacts
    split_frame: DataFrame      # cleaned rows with split, targets and features
    artifact_dir: str | None


def prepare(df_raw: DataFrame, stats: CleanStats | None = None) -> tuple[DataFrame, CleanStats]:
    stats = stats or fit_clean(df_raw)
    return derive_geography(apply_clean(df_raw, stats)), stats


@dataclass(frozen=True)
class Factories:
    """Makers of unfitted Spark ML estimators; with them every target gets its own model."""
    main: Callable[[], object]
    presence: Callable[[], object] | None = None
    amount: Callable[[], object] | None = None


def train_pipeline(spark: SparkSession, df_raw: DataFrame, *, target_cols: Sequence[str],
                   key_col: str = "nct_id", row_key: Sequence[str] | None = None,
                   params: dict | None = None, hurdle_params: dict | None = None, amount_params: dict | None = None,
                   sparse_targets: Sequence[str] = SPARSE_TARGETS, hurdle_eps: float = 0.0, min_positives: int = 1,
                   factories: Factories | None = None, text_encoder: TextEncoder | None = None,
                   text_dim: int = DEFAULT_DIM, use_text: bool = True, fit_scope: str = "all",
                   index_cols: Sequence[str] = (),
                   out_dir: str | None = None, parallelism: int = 8) -> TrainOutputs:
    """clean → geography → split → encoder → features → fit main and hurdles → OOD stats → artifacts.

    One ensemble with vector leaves serves all targets; with ``factories`` each
    target gets a Spark ML model of its own. Settings with
    ``early_stopping_rounds`` stop on the test rows' error. ``row_key`` names
    the columns that tell rows apart (the key column by default).
    ``text_encoder`` replaces the hashed text vector.
    """
    validate_schema()
    row_key = list(row_key or [key_col])
    params, hurdle_params = params or MAIN_PRESET, hurdle_params or HURDLE_PRESET
    clean, stats = prepare(df_raw)
    numeric_guardrails(clean.select(*[c for c in NUMERIC_COLS if c in clean.columns]))
    split = assign_split(clean, key_col=key_col)
    split = extract_targets(split, target_cols)
    enc_rows = split if fit_scope == "all" else split.where(F.col("split") == "train")
    encoder = fit_categorical_encoder(enc_rows, CAT_COLS, index_cols=index_cols)
    cat_names = cat_feature_names(encoder, CAT_COLS)
    if text_encoder is not None:
        register_encoder(text_encoder)
        text_dim = text_encoder.dim
    manifest = build_schema_manifest(
        cat_cols=CAT_COLS, num_cols=NUMERIC_COLS, cat_feature_names=cat_names,
        text_model_name=(text_encoder.encoder_id if text_encoder else HASHING) if use_text else "none",
        text_cols=TEXT_COLS, embedding_dim=text_dim if use_text else 0, targets=target_cols,
        extra={"use_text": use_text, "key_col": key_col, "row_key": row_key,
               "index_cols": list(index_cols),
               "n_features": len(NUMERIC_COLS) + len(cat_names) + (text_dim if use_text else 0)})
    feats = build_features(split, encoder, manifest, row_key)
    # Keep what later stages read (texts, the widest columns, are dropped).
    keep = list(dict.fromkeys([*row_key, key_col, "split", *target_cols, *NUMERIC_COLS, "cat_vec", "features",
                               *(["text_vec", "embedding"] if use_text else [])]))
    feats = feats.select(*[c for c in keep if c in feats.columns])
    # One materialisation of the assembled frame in the shared folder, reused by every fit and by scoring, which read the columns they need.
    feats_path = scratch_dir(spark, "features")
    feats.write.parquet(feats_path)
    feats = spark.read.schema(feats.schema).parquet(feats_path)
    train = feats.where(F.col("split") == "train")
    if factories is not None:
        models, hurdles = fit_all(train, target_cols, sparse_targets, params=params, hurdle_params=hurdle_params, eps=hurdle_eps,
                                  min_positives=min_positives, main_factory=factories.main, presence_factory=factories.presence,
                                  amount_factory=factories.amount, key_cols=row_key, parallelism=parallelism)
    else:
        stops = any((p or {}).get("early_stopping_rounds") for p in (params, hurdle_params, amount_params))
        rows = feats.where(F.col("split") != "holdout").withColumn("_valid", F.col("split") == "test") if stops else train
        models, hurdles = fit_vector(rows, target_cols, sparse_targets, params=params, hurdle_params=hurdle_params, amount_params=amount_params,
                                     eps=hurdle_eps, min_positives=min_positives, valid_col="_valid" if stops else None, key_cols=row_key)
    ood = fit_ood_stats(train, OOD_COLS)
    art = Artifacts(manifest, encoder, models, hurdles, ood, stats)
    if out_dir:
        save_artifacts(spark, out_dir, art)
        art.path = out_dir
    return TrainOutputs(art, feats, out_dir)


def scratch_dir(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def score_with_artifacts(spark: SparkSession, df_raw: DataFrame, art_dir: str, *,
                         impute: str = "frozen", hard_gate: bool = False) -> DataFrame:
    """Load → clean (frozen or batch medians) → geography → score."""
    art = load_artifacts(spark, art_dir)
    stats = art.clean_stats if impute == "frozen" else None
    clean, _ = prepare(df_raw, stats)
    return predict_from_artifacts(clean, art, art.manifest["row_key"], hard_gate=hard_gate)


def evaluate(scored: DataFrame, target_cols: Sequence[str]) -> DataFrame:
    """One scoring pass, metrics per split and target, wide table."""
    return metrics_table(metrics_long(scored, target_cols, [PRED_PREFIX + t for t in target_cols]))


def run_baselines(spark: SparkSession, out: TrainOutputs, target_cols: Sequence[str], *,
                  sparse_targets: Sequence[str] = SPARSE_TARGETS, knn_k: int = 25,
                  params: dict | None = None) -> DataFrame:
    """Mean, mean with sparse targets zeroed, structured-only model, text kNN."""
    feats, row_key = out.split_frame, out.artifacts.manifest["row_key"]
    preds = [PRED_PREFIX + t for t in target_cols]
    tables = {
        "mean": metrics_table(metrics_long(mean_baseline(feats, target_cols, pred_prefix=PRED_PREFIX),
                                           target_cols, preds)),
        "mean_plus_zero_sparse": metrics_table(metrics_long(
            mean_baseline(feats, target_cols, zero_targets=sparse_targets, pred_prefix=PRED_PREFIX),
            target_cols, preds)),
    }
    from cohortspark.operators.features import assemble_features
    struct = assemble_features(feats.drop("features"), output_col="features")
    sm, _ = fit_vector(struct.where(F.col("split") == "train"), target_cols, params=params or STRUCTURED_PRESET, key_cols=row_key)
    tables["structured_only_gbt"] = metrics_table(metrics_long(
        predict_multitarget(struct, sm, pred_prefix=PRED_PREFIX), target_cols, preds))
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in row_key])
    emb = feats.select(F.xxhash64(key).alias("id"), F.col("embedding").alias("vec"), "split",
                       *target_cols, *row_key)
    nb = knn_neighbors(emb, emb.where(F.col("split") == "train"), k=knn_k)
    kp = knn_mean_targets(nb, emb.where(F.col("split") == "train"), target_cols, pred_prefix=PRED_PREFIX)
    knn = emb.join(kp.withColumnRenamed("q_id", "id"), "id")
    tables["text_only_knn"] = metrics_table(metrics_long(knn, target_cols, preds))
    return union_baselines(tables)
