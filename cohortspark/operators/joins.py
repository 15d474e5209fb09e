"""Keyed 1:1 joins of feature blocks (J1, E5) and audits of outside predictions against the truth.

Both are one aggregation: the rows of all sides, tagged, are grouped by key,
and each group holds one row per side and the number of rows of each. The
result is written, and the counts of keys that a side lacks or repeats are
read from its count columns alone. (``observe`` would count while writing, but a
session that has used it can no longer ship Spark ML models that hold a training
summary: the session in them is then not serialisable.) A key repeated by a
third of all rows is one row per task after the partial aggregation.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.metrics import metrics_long
from cohortspark.session import checkpoint_dir


def _by_key(sides: Mapping[str, DataFrame], key_cols: Sequence[str]) -> DataFrame:
    """``(key…, n_<side>, <side> struct)``: one row per key; rows with a null in their key form one key that no side matches."""
    tagged = None
    for name, df in sides.items():
        value = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in key_cols])
        types = {n: d.select(F.struct(*[F.col(f"`{c}`") for c in d.columns if c not in key_cols]).alias("v")).schema["v"].dataType for n, d in sides.items()}
        cols = [value.alias(n) if n == name else F.lit(None).cast(types[n]).alias(n) for n in sides]
        part = df.select(*[F.col(f"`{k}`") for k in key_cols], F.lit(name).alias("_side"), *cols)
        tagged = part if tagged is None else tagged.unionByName(part)
    aggs: list[Column] = []
    for n in sides:
        aggs += [F.count_if(F.col("_side") == n).alias(f"n_{n}"), F.first(n, ignorenulls=True).alias(n)]
    return tagged.groupBy(*[F.col(f"`{k}`") for k in key_cols]).agg(*aggs)


def _written(df: DataFrame, metrics: dict[str, Column], name: str) -> tuple[DataFrame, dict[str, int]]:
    """The frame as a table in the shared folder, and the metrics of it."""
    path = os.path.join(checkpoint_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    return out, {k: int(v or 0) for k, v in out.agg(*[c.alias(k) for k, c in metrics.items()]).first().asDict().items()}


def join_blocks(blocks: Mapping[str, DataFrame], key_cols: Sequence[str]) -> DataFrame:
    """Blocks side by side, one row per key. Every block must hold every key exactly once.

    Raises ``ValueError`` with the counts when a key is null, repeated, or absent from a block.
    """
    names = [c for df in blocks.values() for c in df.columns if c not in key_cols]
    if len(set(names)) != len(names):
        raise ValueError(f"columns appear in several blocks: {sorted({c for c in names if names.count(c) > 1})}")
    grouped = _by_key(blocks, key_cols)
    no_null = F.lit(True)
    for k in key_cols:
        no_null &= F.col(f"`{k}`").isNotNull()
    metrics = {"null_keys": F.count_if(~no_null)}
    for n in blocks:
        metrics[f"missing_{n}"] = F.count_if(no_null & (F.col(f"n_{n}") == 0))
        metrics[f"repeated_{n}"] = F.count_if(no_null & (F.col(f"n_{n}") > 1))
    out, counts = _written(grouped, metrics, "joined-blocks")
    wrong = {k: v for k, v in counts.items() if v}
    if wrong:
        raise ValueError(f"the blocks are not 1:1: {wrong}")
    return out.select(*[F.col(f"`{k}`") for k in key_cols], *[F.col(f"`{n}`.`{c}`").alias(c) for n, df in blocks.items() for c in df.columns if c not in key_cols])


def audit_predictions(truth: DataFrame, predictions: DataFrame, key_cols: Sequence[str], target_cols: Sequence[str], pred_cols: Sequence[str],
                      *, split_col: str = "split", strict: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """``(metrics by split and target, audit)`` of predictions that came from elsewhere.

    The audit counts matched keys, keys of either side alone, and keys either
    side repeats (repeated keys are not scored). ``strict`` raises unless all match once.
    """
    sides = {"truth": truth.select(*key_cols, split_col, *target_cols), "pred": predictions.select(*key_cols, *pred_cols)}
    grouped = _by_key(sides, key_cols)
    no_null = F.lit(True)
    for k in key_cols:
        no_null &= F.col(f"`{k}`").isNotNull()
    once = no_null & (F.col("n_truth") == 1) & (F.col("n_pred") == 1)
    metrics = {"matched": F.count_if(once), "truth_only": F.sum(F.when((F.col("n_pred") == 0) | ~no_null, F.col("n_truth"))),
               "pred_only": F.sum(F.when((F.col("n_truth") == 0) | ~no_null, F.col("n_pred"))),
               "truth_repeated": F.count_if(no_null & (F.col("n_truth") > 1)), "pred_repeated": F.count_if(no_null & (F.col("n_pred") > 1))}
    out, audit = _written(grouped.withColumn("_once", once), metrics, "audit")
    if strict and any(v for k, v in audit.items() if k != "matched"):
        raise ValueError(f"truth and predictions do not match: {audit}")
    pairs = out.where("_once").select(f"truth.{split_col}", *[F.col(f"truth.`{t}`").alias(f"y{i}") for i, t in enumerate(target_cols)],
                                      *[F.col(f"pred.`{p}`").alias(f"p{i}") for i, p in enumerate(pred_cols)])
    k = range(len(target_cols))
    return metrics_long(pairs, [f"y{i}" for i in k], [f"p{i}" for i in k], split_col=split_col, target_names=list(target_cols)), audit
