"""Vector-leaf boosting against a plain restatement; staged errors, early stopping, hurdle members, saved models; path-table attributions."""
import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortspark.operators import multiboost as mb
from cohortspark.operators.treeshap import symmetric_tree_paths, tree_attributions


def plain_tree(x, r, depth, l2):
    """Questions and leaf of every row, all cuts tried one by one."""
    node, asked = np.zeros(len(x), int), []
    for level in range(depth):
        best = None
        for f in range(x.shape[1]):
            for c in np.unique(x[:, f])[:-1]:
                gain = 0.0
                for v in range(1 << level):
                    rows = node == v
                    right = rows & (x[:, f] > c)
                    for part, sign in ((right, 1), (rows & ~right, 1), (rows, -1)):
                        gain += sign * (r[part].sum(0) ** 2).sum() / (part.sum() + l2)
                gain = float(f"{gain:.9e}")
                if best is None or gain > best[0]:
                    best = (gain, f, c)
        if best[0] <= 0:
            break
        asked.append(best[1:])
        node |= (x[:, best[1]] > best[2]).astype(int) << level
    return asked, node


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (600, 4)).astype(float)
    x[:, 3] = rng.integers(0, 2, 600)
    y = np.stack([x[:, 0] * 0.1 + x[:, 3] * 0.3, np.where(x[:, 1] > 2, x[:, 2], 0) * 0.15], 1) + rng.normal(0, 0.02, (600, 2))
    z = np.where(x[:, 1] > 3, np.abs(y[:, 0]), 0.0)
    rows = [(i, *map(float, a), *map(float, b), float(c), i % 4 == 0) for i, (a, b, c) in enumerate(zip(x, y, z))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y0 double, y1 double, z double, v boolean")
    df = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df).cache()
    return df, x, y


def test_trees_equal_plain_restatement(frame):
    df, x, y = frame
    model = mb.fit_members(df, [mb.Member("m", ("y0", "y1"), iterations=3, depth=3, learning_rate=0.5, l2_leaf_reg=2.0)], key_cols=["id"])["m"]
    pred = np.tile(y.mean(0), (len(y), 1))
    for t in model.trees:
        r = y - pred
        asked, node = plain_tree(x, r, 3, 2.0)
        assert asked == list(zip(t.features, t.cuts))
        step = np.stack([0.5 * r[node == v].sum(0) / ((node == v).sum() + 2.0) for v in range(8)])
        assert np.allclose(step, t.leaves) and np.allclose(t.cover, np.bincount(node, minlength=8))
        pred += step[node]
    got = model.predict(df, ["p0", "p1"]).orderBy("id").select("p0", "p1").collect()
    assert np.allclose(np.array(got, float), pred)


def test_many_partitions_and_refresh_change_nothing(frame, monkeypatch):
    df, _, _ = frame
    members = [mb.Member("m", ("y0", "y1"), iterations=5, depth=2, learning_rate=0.3), mb.Member("n", ("y1",), iterations=3, depth=3, learning_rate=0.3)]
    one = mb.fit_members(df, members, key_cols=["id"])
    monkeypatch.setattr(mb, "ROWS_PER_PARTITION", 8)  # 75 partitions: histograms are summed in two stages
    monkeypatch.setattr(mb, "REFRESH", 2)
    many = mb.fit_members(df, members, key_cols=["id"])
    for name in one:
        for a, b in zip(one[name].trees, many[name].trees, strict=True):
            assert (a.features, a.codes, a.cuts) == (b.features, b.codes, b.cuts) and np.allclose(a.leaves, b.leaves)


def test_staged_errors_and_early_stopping(spark, frame):
    df, _, _ = frame
    noisy = df.withColumn("y0", F.when(F.col("v"), F.rand(3)).otherwise(F.col("y0")))  # validation soon stops improving
    member = mb.Member("m", ("y0", "y1"), iterations=60, depth=3, learning_rate=0.5, early_stopping_rounds=4)
    model = mb.fit_members(noisy, [member], valid_col="v", key_cols=["id"])["m"]
    assert model.best_round == len(model.trees) and len(model.staged) - 1 < 60
    assert len(model.staged) - 1 - model.best_round >= 4
    table = mb.staged_errors(noisy.where("v"), model).orderBy("round").collect()
    assert np.allclose([r["rmse"] for r in table], model.staged[:len(table)])
    path = os.path.join(tempfile.mkdtemp(prefix="cs-boost-"), "m")
    model.save(spark, path)
    again = mb.BoostModel.load(spark, path)
    assert list(again) == ["y0", "y1"] and again.staged == model.staged
    a, b = (m.predict(df, ["p", "q"]).orderBy("id").select("p", "q").collect() for m in (model, again))
    assert a == b


def test_presence_and_amount(frame):
    df, x, _ = frame
    out = mb.fit_members(df, [mb.Member("p", ("z",), iterations=6, depth=2, learning_rate=0.5, loss="logloss"),
                              mb.Member("r", ("z",), iterations=6, depth=2, learning_rate=0.5, only_positive=True)], key_cols=["id"])
    rows = out["r"].predict(out["p"].predict(df, ["p"]), ["r"]).select("z", "p", "r").collect()
    assert all((r["p"] > 0.5) == (r["z"] > 0) for r in rows)
    assert abs(out["r"].base[0] - np.mean([r["z"] for r in rows if r["z"] > 0])) < 1e-9
    # first step of the logistic ensemble: sum(y - p) / (sum p (1 - p) + l2) in each leaf
    t = out["p"].trees[0]
    y = np.array([float(r["z"] > 0) for r in rows])
    p = y.mean()
    assert t.features[0] == 1 and math.isclose(t.cover.sum(), len(y) * p * (1 - p), rel_tol=1e-9)


def test_bad_settings(frame):
    df, _, _ = frame
    with pytest.raises(ValueError):
        mb.Member("m", ("a", "b"), loss="logloss")
    with pytest.raises(ValueError):
        mb.member_of("m", ["a"], {"depht": 3})
    with pytest.raises(ValueError):
        mb.fit_members(df.limit(0), [mb.Member("m", ("y0",))])
    constant = mb.fit_members(df.withColumn("k", F.lit(0.5)), [mb.Member("m", ("k",), iterations=5)])["m"]
    assert not constant.trees and constant.base[0] == 0.5
    wide = mb.fit_members(df, [mb.Member("m", ("y0",), iterations=2, depth=2)], max_bins=4)["m"]
    assert len(wide.trees) == 2


def test_vector_attributions(spark, frame):
    df, _, _ = frame
    model = mb.fit_members(df, [mb.Member("m", ("y0", "y1"), iterations=4, depth=3, learning_rate=0.5)], key_cols=["id"])["m"]
    sample = df.where("id < 20")
    long, base = tree_attributions(sample, model, key_col="id")
    phi = np.zeros((20, 4, 2))
    for r in long.collect():
        phi[int(r["key"]), r["feature_idx"], model.targets.index(r["target"])] = r["value"]
    x = np.array([r["x"] for r in sample.orderBy("id").select(vector_to_array("features").alias("x")).collect()])
    raw = model.raw_values(x)
    assert np.allclose(phi.sum(1) + [base["y0"], base["y1"]], raw)
    # definition: average gain over all orders, unknown features averaged by cover
    from itertools import permutations
    want = np.zeros((4, 2))

    def value(known):
        out = np.zeros(2)
        for t in model.trees:
            share = np.ones(len(t.leaves))
            for leaf in range(len(share)):
                for j, f in enumerate(t.features):
                    side = leaf >> j & 1
                    if f in known:
                        share[leaf] *= (x[0, f] > t.cuts[j]) == side
                    else:
                        same = [n for n in range(len(share)) if n % (1 << j) == leaf % (1 << j)]
                        above = t.cover[same].sum()
                        share[leaf] *= t.cover[[n for n in same if n >> j & 1 == side]].sum() / above if above else 0.0
            out += share @ t.leaves
        return out
    for order in permutations(range(4)):
        for i in range(4):
            want[order[i]] += (value(set(order[:i + 1])) - value(set(order[:i]))) / 24
    assert np.allclose(phi[0], want)
    assert symmetric_tree_paths(model.trees[0]).cover.shape == (8, len(set(model.trees[0].features)))


def test_parzen_search_finds_the_basin():
    """On a known bowl the later trials are better than random ones, and every setting stays in range."""
    import random

    from cohortspark.operators.tuning import SEARCH_SPACE, Parzen, suggest

    def error(p):
        return (p["depth"] - 7) ** 2 / 16 + (math.log(p["learning_rate"]) - math.log(0.02)) ** 2 + (p["l2_leaf_reg"] - 2) ** 2 / 81 + (p["iterations"] - 550) ** 2 / 160_000
    better = 0
    for seed in range(12):
        rng, done = random.Random(seed), []
        while len(done) < 40:
            done += [(p, error(p)) for p in suggest(SEARCH_SPACE, done, 5, rng)]
        assert all(lo <= p[k] <= hi for p, _ in done for k, (lo, hi) in SEARCH_SPACE.items())
        late, early = np.median([e for _, e in done[25:]]), np.median([e for _, e in done[:10]])
        better += late < early
    assert better >= 10
    grid = (np.arange(2000) + 0.5) / 2000
    assert abs(np.mean([Parzen([0.1, 0.5, 0.52]).density(u) for u in grid]) - 1) < 1e-3
    rng = random.Random(3)
    assert suggest(SEARCH_SPACE, [], 3, rng) != suggest(SEARCH_SPACE, [], 3, rng)
    assert suggest(SEARCH_SPACE, [], 3, random.Random(1)) == suggest(SEARCH_SPACE, [], 3, random.Random(1))


def test_too_few_positives(frame):
    """The robust variant skips the amount half below five positive rows; one class needs no presence half."""
    from cohortspark.operators.models import ROBUST_MIN_POSITIVES, fit_vector
    df, _, _ = frame
    rows = df.withColumn("rare", (F.col("id") < 3).cast("double") * 0.4).withColumn("never", F.lit(0.0))
    small = {"iterations": 2, "depth": 2, "learning_rate": 0.5}
    _, hurdles = fit_vector(rows, ["y0", "rare", "never", "z"], ["rare", "never", "z", "not a target"], params=small, hurdle_params=small, min_positives=ROBUST_MIN_POSITIVES, key_cols=["id"])
    assert set(hurdles) == {"rare", "never", "z"}
    assert hurdles["rare"].regressor is None and hurdles["rare"].presence is not None and hurdles["z"].regressor is not None
    assert hurdles["never"].presence is None and hurdles["never"].constant_presence == 0.0
    assert {r["rare__y_pred"] for r in hurdles["rare"].transform(rows).select("rare__y_pred").collect()} == {0.0}


def test_numeric_guards(spark):
    from cohortspark.operators.geo import numeric_guardrails
    from cohortspark.schema import NUMERIC_COLS
    df = spark.createDataFrame([tuple(range(len(NUMERIC_COLS)))], ", ".join(f"{c} int" for c in NUMERIC_COLS)).withColumns({"n_us_regions": F.lit(2)})
    assert numeric_guardrails(df)["max_sites"] == NUMERIC_COLS.index("n_sites")
    for wrong, word in ((df.drop("n_sites"), "lacks"), (df.withColumn("more", F.lit(1)), "not expected"), (df.drop("min_age_missing"), "absent"), (df.withColumn("n_sites", F.lit(0)), "no row"),
                        (df.withColumn("n_us_states", F.lit(-1)), "below zero")):
        with pytest.raises(ValueError, match=word):
            numeric_guardrails(wrong)
