"""Hurdle/renormalisation literals, one-hot semantics, metrics, artifacts, batch = stream scoring."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cohortspark.operators.models import CHECK_PRESET
from cohortspark.operators.features import (
    cat_feature_names, encode_categoricals, fit_categorical_encoder,
)
from cohortspark.operators.hurdle import hurdle_combine, sex_renormalize
from cohortspark.operators.metrics import metrics_long, metrics_table
from cohortspark.operators.scoring import resolve_override

SMALL = "/root/testdata/sf0.001"


def test_hurdle_literals(spark):
    df = spark.createDataFrame([(0.5, 1.4), (0.49, 0.3)], "p double, yc double")
    soft = df.select(*[v.alias(k) for k, v in hurdle_combine(F.col("p"), F.col("yc")).items()]).collect()
    hard = df.select(*[v.alias(k) for k, v in hurdle_combine(F.col("p"), F.col("yc"), hard_gate=True).items()]).collect()
    assert soft[0]["y_cond"] == 1.0 and soft[0]["y_pred"] == 0.5 and soft[0]["present"]
    assert hard[0]["y_pred"] == 1.0 and hard[1]["y_pred"] == 0.0 and not hard[1]["present"]


def test_sex_renormalise_literals(spark):
    df = spark.createDataFrame([(0.6, 0.6), (0.0, 0.0)], "a double, b double")
    a, b = sex_renormalize(F.col("a"), F.col("b"))
    assert [tuple(r) for r in df.select(a, b).collect()] == [(0.5, 0.5), (0.0, 0.0)]


def test_onehot_unknown_is_all_zero(spark):
    cols = ["c"]
    fit = spark.createDataFrame([("b",), ("a",), ("c",), ("b",)], "c string")
    model = fit_categorical_encoder(fit, cols)
    assert cat_feature_names(model, cols) == ["c_a", "c_b", "c_c"]
    test = spark.createDataFrame([("a",), ("zzz",), (None,)], "c string")
    vecs = [r["cat_vec"].toArray().tolist() for r in encode_categoricals(test, model, cols).collect()]
    assert vecs == [[1.0, 0.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]]
    bounded = fit_categorical_encoder(fit, cols, index_cols=cols)
    assert cat_feature_names(bounded, cols) == ["c__index"]


def test_metrics_clip_and_table(spark):
    df = spark.createDataFrame([("train", 1.0, 1.5), ("train", 0.0, 0.5), ("test", 0.5, 0.5), ("holdout", 0.2, -1.0)],
                               "split string, y double, p double")
    long = {(r["split"], r["target"]): r for r in metrics_long(df, ["y"], ["p"]).collect()}
    assert long[("train", "y")]["mae"] == pytest.approx(0.25)
    assert long[("train", "y")]["rmse"] == pytest.approx((0.25 / 2) ** 0.5)
    assert long[("holdout", "y")]["mae"] == pytest.approx(0.2)
    wide = metrics_table(metrics_long(df, ["y"], ["p"])).first()
    assert wide["Target"] == "y" and wide["Test RMSE"] == 0.0


def test_override_resolution():
    cols = ["pred_male_pct", "pred_female_pct", "pred_aian_pct"]
    assert resolve_override(cols, "aian_pct") == "pred_aian_pct"
    assert resolve_override(cols, "AIAN") == "pred_aian_pct"
    with pytest.raises(ValueError):
        resolve_override(cols, "male")
    assert resolve_override(cols, "nope") is None


def test_artifacts_round_trip_and_stream_equals_batch(spark):
    from cohortspark.plans import train as TJ
    from cohortspark.schema import TARGET_COLS
    from cohortspark.sources.artifacts import artifact_summary, load_artifacts
    from cohortspark.sources.trials_view import trials_path, trials_view
    from cohortspark.streaming.score_stream import read_parquet_stream, start_stream_scoring
    raw = trials_view(spark, SMALL)
    art_dir = os.path.join(tempfile.mkdtemp(prefix="cs-art-"), "a")
    TJ.train_pipeline(spark, raw, target_cols=TARGET_COLS, out_dir=art_dir, text_dim=16,
                      params=CHECK_PRESET, hurdle_params=CHECK_PRESET, index_cols=("sponsor",), row_key=["row_id", "copy_no"])
    art = load_artifacts(spark, art_dir)
    assert set(art.models) == set(TARGET_COLS) and art.clean_stats is not None
    assert artifact_summary(spark, art_dir).count() > 0
    preds = [f"pred_{t}" for t in TARGET_COLS]
    batch = TJ.score_with_artifacts(spark, raw, art_dir).select("row_id", "copy_no", *preds)
    b = {(r[0], r[1]): tuple(round(x, 9) for x in r[2:]) for r in batch.collect()}
    for r in b.values():
        assert all(0.0 <= x <= 1.0 for x in r)
    out_dir = os.path.join(tempfile.mkdtemp(prefix="cs-stream-"), "o")
    q = start_stream_scoring(spark, read_parquet_stream(spark, trials_path(spark, SMALL), raw.schema, 2),
                             art_dir, out_dir, select_cols=["row_id", "copy_no", *preds])
    q.awaitTermination()
    s = {(r[0], r[1]): tuple(round(x, 9) for x in r[2:6 + 4]) for r in
         spark.read.parquet(out_dir).select("row_id", "copy_no", *preds).collect()}
    assert s == b
    with pytest.raises(FileNotFoundError):
        load_artifacts(spark, os.path.join(art_dir, "missing"))


def test_positional_target_names_and_target_slice(spark):
    from cohortspark.operators.attribution import attributions_for_target
    df = spark.createDataFrame([("train", 1.0, 0.5, 0.0, 0.0)], "split string, a double, pa double, b double, pb double")
    got = {r["target"] for r in metrics_long(df, ["a", "b"], ["pa", "pb"], target_names=[]).collect()}
    assert got == {"target_0", "target_1"}
    with pytest.raises(ValueError):
        metrics_long(df, ["a", "b"], ["pa", "pb"], target_names=["x"])
    long = spark.createDataFrame([("k", "t1", "f", 1.0), ("k", "t2", "f", 2.0)],
                                 "key string, target string, feature string, value double")
    assert [r["value"] for r in attributions_for_target(long, "t2").collect()] == [2.0]


def test_features_are_read_by_column(spark):
    """The assembled frame lies in the shared folder as Parquet, so that a step reads the columns it needs; vectors keep their attributes."""
    from cohortspark.plans import train as TJ
    from cohortspark.schema import TARGET_COLS
    from cohortspark.sources.trials_view import trials_view
    small = {"iterations": 1, "depth": 1, "learning_rate": 0.3}
    out = TJ.train_pipeline(spark, trials_view(spark, SMALL), target_cols=TARGET_COLS, text_dim=8, params=small, sparse_targets=(),
                            index_cols=("sponsor",), row_key=["row_id", "copy_no"])
    files = out.split_frame.inputFiles()
    assert files and all(f.endswith(".parquet") for f in files)
    assert "ml_attr" in out.split_frame.schema["features"].metadata
    assert out.split_frame.count() == trials_view(spark, SMALL).count()
