"""Frozen-artifact scoring.

A chain of narrow transforms after the per-row embedding aggregate: no
shuffle of the scored rows beyond that, and the same function runs inside
``foreachBatch`` for streams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.numeric import clip01
from cohortspark.functions.text import merge_text
from cohortspark.operators.embed import text_embedding
from cohortspark.operators.features import (
    assemble_features, encode_categoricals, numeric_block, text_vector,
)
from cohortspark.operators.hurdle import sex_columns, sex_renormalize
from cohortspark.operators.models import predict_multitarget
from cohortspark.schema import SEX_TARGET_NAMES

PRED_PREFIX = "pred_"


def build_features(df: DataFrame, encoder, manifest: dict, key_cols: Sequence[str]) -> DataFrame:
    """M5/M6 driven by the manifest: numeric block, one-hot, text vector (hashed, or of the named encoder), assembled."""
    out = numeric_block(df, manifest["num_cols"])
    out = encode_categoricals(out, encoder, manifest["cat_cols"])
    use_text = manifest.get("use_text", True)
    if use_text:
        present = [c for c in manifest["text_cols"] if c in df.columns]
        out = out.withColumn("merged_text", merge_text(present, manifest["text_cols"]))
        out = text_embedding(out, "merged_text", manifest["text_model_name"], dim=manifest["embedding_dim"])
        out = text_vector(out)
    return assemble_features(out, num_cols=manifest["num_cols"], with_text=use_text)


def resolve_override(pred_cols: Sequence[str], target: str) -> str | None:
    """Exact name first; else the single column whose name contains the
    target (case-insensitive). Several candidates → error (never guess)."""
    exact = PRED_PREFIX + target
    if exact in pred_cols:
        return exact
    cands = [c for c in pred_cols if target.lower() in c.lower()]
    if len(cands) > 1:
        raise ValueError(f"hurdle target {target!r} matches several prediction columns: {cands}")
    return cands[0] if cands else None


def apply_constraints(df: DataFrame, pred_cols: Sequence[str], *, clip: bool = True,
                      renorm: str | None = "package") -> DataFrame:
    """Clip to [0, 1], then make the first two sex columns sum to one."""
    out = df
    if clip:
        out = out.withColumns({c: clip01(F.col(c)) for c in pred_cols})
    if renorm:
        names = {c[len(PRED_PREFIX):]: c for c in pred_cols}
        sx = sex_columns(list(names), SEX_TARGET_NAMES)
        if len(sx) >= 2:
            a, b = names[sx[0]], names[sx[1]]
            na, nb = sex_renormalize(F.col(a), F.col(b), variant=renorm)
            out = out.withColumns({a: na, b: nb})
    return out


def score_frame(features: DataFrame, art, *, hard_gate: bool = False, clip: bool = True,
                renorm: str | None = "package") -> DataFrame:
    """Main predictions, hurdle override, clip, renormalise (``features`` already assembled)."""
    out = predict_multitarget(features, art.models, pred_prefix=PRED_PREFIX)
    pred_cols = [PRED_PREFIX + t for t in art.models]
    for t, h in art.hurdles.items():
        col = resolve_override(pred_cols, t)
        if col is None:
            continue
        out = h.transform(out, hard_gate=hard_gate, clip=clip, prefix=f"_h_{t}__")
        out = out.withColumn(col, F.col(f"_h_{t}__y_pred")).drop(
            *[f"_h_{t}__{x}" for x in ("y_pred", "p_present", "y_cond", "present")])
    return apply_constraints(out, pred_cols, clip=clip, renorm=renorm)


def predict_from_artifacts(df_clean: DataFrame, art, key_cols: Sequence[str], **kwargs) -> DataFrame:
    """Cleaned (+ geography) rows → features by manifest → constrained predictions."""
    feats = build_features(df_clean, art.encoder, art.manifest, key_cols)
    return score_frame(feats, art, **kwargs)
