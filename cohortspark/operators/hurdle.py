"""Two-stage "hurdle" models: presence classifier, then amount regressor.

Prediction algebra is pure column arithmetic on the two model outputs, so
scoring stays a narrow projection (no shuffle) on batches and streams.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.numeric import clip01, sigmoid
from cohortspark.operators.multiboost import BoostModel

# Presence threshold (inclusive) and the value used below it.
HURDLE_THRESHOLD = 0.5
HURDLE_ZERO_VALUE = 0.0


def presence_label(y: Column, eps: float = 0.0) -> Column:
    """1 where y > eps."""
    return (y > F.lit(eps)).cast("int")


def model_outputs(model, df: DataFrame, prefix: str, *, features_col: str = "features") -> tuple[DataFrame, dict[str, str]]:
    """Apply any fitted model; returns the frame and the columns the model offers.

    Keys: ``probability`` and ``raw`` where the model has them, always
    ``prediction``. Models are Spark ML models or ensembles with vector leaves.
    """
    if isinstance(model, BoostModel):
        name = prefix + ("prob" if model.loss == "logloss" else "value")
        return model.predict(df, [name], features_col=features_col), {"probability" if model.loss == "logloss" else "prediction": name}
    m = model.copy()
    offered = {}
    for key, param in (("probability", "probabilityCol"), ("raw", "rawPredictionCol"), ("prediction", "predictionCol")):
        if m.hasParam(param):
            offered[key] = prefix + key
            m.set(m.getParam(param), offered[key])
    m.set(m.getParam("featuresCol"), features_col)
    return m.transform(df), offered


def presence_probability(df: DataFrame, offered: dict[str, str]) -> Column:
    """P(present) = probability, else sigmoid of the raw score, else label > 0."""
    def second(name: str) -> Column:
        is_vector = isinstance(df.schema[name].dataType, VectorUDT)
        return vector_to_array(F.col(name))[1] if is_vector else F.col(name)
    if "probability" in offered:
        return second(offered["probability"])
    if "raw" in offered:
        return sigmoid(second(offered["raw"]))
    return (F.col(offered["prediction"]) > 0).cast("double")


def hurdle_combine(p: Column, y_cond: Column, *, hard_gate: bool = False, clip: bool = True, clip_amount: bool = True,
                   threshold: float = HURDLE_THRESHOLD) -> dict[str, Column]:
    """``y_pred = p·y_cond`` (soft) or ``y_cond if p >= t else 0`` (hard).

    ``clip`` clips the result, ``clip_amount`` (with ``clip``) the amount before it is multiplied as well (M20: one
    variant clips the amount first, the other only the product).

    Returns the four output columns: y_pred, p_present, y_cond, present.
    """
    yc = clip01(y_cond) if clip and clip_amount else y_cond
    present = p >= F.lit(threshold)
    y = F.when(present, yc).otherwise(F.lit(HURDLE_ZERO_VALUE)) if hard_gate else p * yc
    if clip:
        y = clip01(y)
    return {"y_pred": y, "p_present": p, "y_cond": yc, "present": present}


def sex_renormalize(a: Column, b: Column, *, variant: str = "package") -> tuple[Column, Column]:
    """Make two shares sum to 1.

    package: denominator 0 → 1; notebook_eps: denominator + 1e-8, re-clipped;
    positive_only: only rows whose sum is > 0 are changed.
    """
    s = a + b
    if variant == "package":
        d = F.when(s == 0, F.lit(1.0)).otherwise(s)
        return a / d, b / d
    if variant == "notebook_eps":
        d = s + F.lit(1e-8)
        return clip01(a / d), clip01(b / d)
    if variant == "positive_only":
        return (F.when(s > 0, a / s).otherwise(a), F.when(s > 0, b / s).otherwise(b))
    raise ValueError(f"unknown renormalisation variant {variant!r}")


def sex_columns(columns: Sequence[str], allowed: Sequence[str]) -> list[str]:
    """Columns whose lower-case name is in ``allowed``, in column order."""
    allow = {x.lower() for x in allowed}
    return [c for c in columns if c.lower() in allow]


@dataclass
class HurdleModel:
    """A fitted presence classifier + amount regressor for one target."""
    target: str
    presence: object            # any fitted model (see model_outputs), or None
    regressor: object           # any fitted model, or None (too few positives → 0)
    threshold: float = HURDLE_THRESHOLD
    constant_presence: float | None = None   # used when the presence label had one class

    def transform(self, df: DataFrame, *, features_col: str = "features", hard_gate: bool = False,
                  clip: bool = True, prefix: str | None = None) -> DataFrame:
        prefix = prefix or f"{self.target}__"
        tmp, spare = df, []
        if self.presence is not None:
            tmp, offered = model_outputs(self.presence, tmp, prefix + "c_", features_col=features_col)
            p, spare = presence_probability(tmp, offered), [*spare, *offered.values()]
        else:
            p = F.lit(float(self.constant_presence or 0.0))
        if self.regressor is not None:
            tmp, offered = model_outputs(self.regressor, tmp, prefix + "r_", features_col=features_col)
            yc, spare = F.col(offered["prediction"]), [*spare, *offered.values()]
        else:
            yc = F.lit(0.0)
        outs = hurdle_combine(p, yc, hard_gate=hard_gate, clip=clip, threshold=self.threshold)
        return tmp.withColumns({prefix + k: v for k, v in outs.items()}).drop(*spare)
