"""1:1 joins, audits, exact quantiles, ranks, published tables, and the encoder slot."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import embed, joins, quantile, ranking
from cohortspark.sources.writers import publish_tables, read_published


def test_one_to_one(spark):
    a = spark.createDataFrame([(i, i * 2) for i in range(50)], "k long, a long")
    b = spark.createDataFrame([(i, f"x{i}") for i in reversed(range(50))], "k long, b string")
    out = joins.join_blocks({"a": a, "b": b}, ["k"]).orderBy("k").collect()
    assert [tuple(r) for r in out] == [(i, i * 2, f"x{i}") for i in range(50)]
    for wrong, word in ((b.where("k > 3"), "missing_b"), (b.union(b.where("k = 7")), "repeated_b"), (b.union(spark.createDataFrame([(None, "z")], b.schema)), "null_keys"),
                        (b.union(spark.createDataFrame([(99, "z")], b.schema)), "missing_a")):
        with pytest.raises(ValueError, match=word):
            joins.join_blocks({"a": a, "b": wrong}, ["k"])
    with pytest.raises(ValueError, match="several blocks"):
        joins.join_blocks({"a": a, "b": a}, ["k"])
    nulls = spark.createDataFrame([(1, None)], "k long, b string")
    assert joins.join_blocks({"a": a.where("k = 1"), "b": nulls}, ["k"]).first()["b"] is None
    assert joins.join_blocks({"a": a.limit(0), "b": b.limit(0)}, ["k"]).count() == 0


def test_audit(spark):
    truth = spark.createDataFrame([(1, "train", 0.5), (2, "train", 0.1), (3, "test", 0.2), (4, "test", 0.9), (4, "test", 0.9), (None, "test", 0.3)], "k long, split string, y double")
    pred = spark.createDataFrame([(1, 0.4), (3, 0.2), (5, 0.1), (5, 0.1), (4, 0.9), (None, 0.3)], "k long, p double")
    long, audit = joins.audit_predictions(truth, pred, ["k"], ["y"], ["p"])
    assert audit == {"matched": 2, "truth_only": 2, "pred_only": 3, "truth_repeated": 1, "pred_repeated": 1}
    got = {r["split"]: (round(r["rmse"], 9), r["n"]) for r in long.collect()}
    assert got == {"train": (0.1, 1), "test": (0.0, 1)}
    with pytest.raises(ValueError, match="do not match"):
        joins.audit_predictions(truth, pred, ["k"], ["y"], ["p"], strict=True)


def test_quantiles(spark, monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(quantile, "FEW", 20)
    monkeypatch.setattr(quantile, "BUCKETS", 7)
    for x in (rng.normal(size=300), np.repeat(3.0, 90), np.round(np.append(rng.exponential(size=200), [1e300, -1e300]), 1)):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
        for q in (0.0, 0.5, 0.99):
            assert np.isclose(quantile.exact_quantile(df, "v", q), np.quantile(x, q), rtol=1e-12), q
    assert quantile.exact_quantile(df.limit(0), "v", 0.5) is None


def test_ranks_and_published_tables(spark, tmp_path):
    df = spark.range(1000).select(F.xxhash64("id").alias("h"), "id").repartition(7)
    ranked = ranking.global_rank(df, "h", "id").collect()
    assert [r["rank"] for r in sorted(ranked, key=lambda r: (r["h"], r["id"]))] == list(range(1, 1001))
    out = str(tmp_path / "tables")
    publish_tables({"a": spark.createDataFrame([(2, "y, \"q\""), (1, "x")], "rank long, name string"), "b": spark.range(3)}, out)
    first = read_published(spark, out)
    assert [tuple(r) for r in first["a"].collect()] == [(1, "x"), (2, "y, \"q\"")] and first["b"].count() == 3
    publish_tables({"a": spark.createDataFrame([(1, "new")], "rank long, name string")}, out)
    assert list(read_published(spark, out)) == ["a"] and first["b"].count() == 3  # readers of the run before are not disturbed


def test_encoder_is_built_once_a_worker(spark, tmp_path):
    def _build(files):
        from cohortspark.operators import embed

        with open(files["scale.txt"]) as f:
            scale = float(f.read())

        class Toy:
            def encode(self, texts, max_length):
                assert all(len(a) <= len(b) for a, b in zip(texts, texts[1:])), "a batch holds texts of like length"
                return [[len(t) * scale, os.getpid(), embed.BUILDS["toy-lengths"], 0 if max_length is None else max_length] for t in texts]
        return Toy()

    (tmp_path / "scale.txt").write_text("0.5")
    enc = embed.register_encoder(embed.TextEncoder("toy-lengths", 4, _build, files=(str(tmp_path / "scale.txt"),), batch_size=3, max_length=9))
    texts = ["x" * (i * 7 % 23) for i in range(200)] + [None]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "id long, t string, other string").repartition(16)
    seen = {}
    for _ in range(2):  # two jobs, 32 tasks
        for r in embed.text_embedding(df, "t", "toy-lengths", dim=4).collect():
            assert r["embedding"][0] == len(texts[r["id"]] or "") / 2 and r["embedding"][3] == 9 and r["other"] == "kept"
            seen.setdefault(r["embedding"][1], set()).add(r["embedding"][2])
    assert all(len(v) == 1 for v in seen.values())  # the number of builds a worker has made never grows
    with pytest.raises(KeyError, match="not registered"):
        embed.text_embedding(df, "t", "unknown", dim=4)
    with pytest.raises(ValueError, match="dimensions"):
        embed.text_embedding(df, "t", "toy-lengths", dim=5)
    with pytest.raises(ValueError):
        embed.register_encoder(embed.TextEncoder(embed.HASHING, 4, _build))
    assert enc.encoder_id in embed.ENCODERS


def test_encoder_through_training_and_frozen_scoring(spark, tmp_path):
    from cohortspark.plans import train as TJ
    from cohortspark.schema import TARGET_COLS
    from cohortspark.sources.trials_view import trials_view
    (tmp_path / "scale.txt").write_text("0.01")

    def build(files):
        class Lengths:
            def encode(self, texts, max_length):
                return [[len(t) / 1000, t.count("a") / 100] for t in texts]
        return Lengths()
    enc = embed.TextEncoder("two-numbers", 2, build)
    raw = trials_view(spark, "/root/testdata/sf0.001")
    art = str(tmp_path / "art")
    small = {"iterations": 2, "depth": 2, "learning_rate": 0.5}
    out = TJ.train_pipeline(spark, raw, target_cols=TARGET_COLS, row_key=["row_id", "copy_no"], params=small, sparse_targets=(), text_encoder=enc, index_cols=("sponsor",), out_dir=art)
    assert out.artifacts.manifest["text_model_name"] == "two-numbers" and out.artifacts.manifest["embedding_dim"] == 2
    scored = TJ.score_with_artifacts(spark, raw, art)
    assert scored.count() == raw.count() and {"pred_" + t for t in TARGET_COLS} <= set(scored.columns)


def test_factories_reach_the_job(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import LinearRegression
    from cohortspark.plans import train as TJ
    from cohortspark.sources.artifacts import load_artifacts
    from cohortspark.sources.trials_view import trials_view
    raw = trials_view(spark, "/root/testdata/sf0.001")
    make = TJ.Factories(lambda: LinearRegression(maxIter=2), lambda: LogisticRegression(maxIter=2), lambda: LinearRegression(maxIter=2))
    art = str(tmp_path / "art")
    TJ.train_pipeline(spark, raw, target_cols=["white_pct", "aian_pct"], row_key=["row_id", "copy_no"], sparse_targets=["aian_pct"], factories=make, use_text=False,
                      index_cols=("sponsor",), out_dir=art)
    loaded = load_artifacts(spark, art)
    assert type(loaded.models["white_pct"]).__name__ == "LinearRegressionModel" and type(loaded.hurdles["aian_pct"].presence).__name__ == "LogisticRegressionModel"
    scored = TJ.score_with_artifacts(spark, raw, art).select("pred_white_pct", "pred_aian_pct").collect()
    assert all(0 <= r[0] <= 1 and 0 <= r[1] <= 1 for r in scored)
