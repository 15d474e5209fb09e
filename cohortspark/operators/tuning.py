"""Tree-structured Parzen search over boosted-tree settings for one target.

Trials come in batches. The first batches are drawn at random; later ones from
the finished trials: the best share of them gives a density of good settings,
the rest one of bad settings (per dimension a mixture of normals cut to the
range, plus the range itself), and of some candidates drawn from the good
density the one with the highest good / bad ratio is tried. Settings already
chosen for the same batch count as bad, so a batch spreads out. The trials of
a batch are members of one ensemble job: they share every pass over the rows.
"""

from __future__ import annotations

import math
import os
import random
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.multiboost import BoostModel, Member, grow_members, prepare_rows
from cohortspark.operators.split import sample_n
from cohortspark.schema import RANDOM_SEED
from cohortspark.session import checkpoint_dir

# The reference's search space, trial count, patience and validation size.
SEARCH_SPACE = {"iterations": (200, 600), "depth": (4, 8), "learning_rate": (0.01, 0.2),
                "l2_leaf_reg": (1.0, 10.0)}
LOG_SCALE = ("learning_rate",)
N_TRIALS = 25
PATIENCE = 30
MIN_VALID = 40
VALID_FRAC = 0.15
# Settings of the sampler.
N_RANDOM = 10
GOOD_SHARE = 0.25
N_CANDIDATES = 24


def _to_line(name: str, value: float, space: dict) -> float:
    """A setting as a number in [0, 1] (integers at the middle of their cell)."""
    lo, hi = space[name]
    if isinstance(lo, int):
        return (value - lo + 0.5) / (hi - lo + 1)
    if name in LOG_SCALE:
        lo, hi, value = math.log(lo), math.log(hi), math.log(value)
    return (value - lo) / (hi - lo) if hi > lo else 0.5


def _from_line(name: str, u: float, space: dict):
    lo, hi = space[name]
    if isinstance(lo, int):
        return min(hi, lo + int(u * (hi - lo + 1)))
    if name in LOG_SCALE:
        return math.exp(math.log(lo) + u * (math.log(hi) - math.log(lo)))
    return lo + u * (hi - lo)


class Parzen:
    """Density on [0, 1]: normals around the points, cut to the range, and the range itself as one more part."""

    def __init__(self, points: Sequence[float]):
        self.points = sorted(points)
        # each point is as wide as its farther neighbour is away, within bounds
        ends = [0.0, *self.points, 1.0]
        narrow = 1.0 / min(100.0, 1.0 + len(self.points))
        self.widths = [min(1.0, max(b - a, c - b, narrow)) for a, b, c in zip(ends, ends[1:], ends[2:])]

    def density(self, u: float) -> float:
        total = 1.0
        for m, w in zip(self.points, self.widths):
            inside = 0.5 * (math.erf((1 - m) / (w * math.sqrt(2))) - math.erf((0 - m) / (w * math.sqrt(2))))
            total += math.exp(-0.5 * ((u - m) / w) ** 2) / (w * math.sqrt(2 * math.pi) * inside)
        return total / (len(self.points) + 1)

    def draw(self, rng: random.Random) -> float:
        at = rng.randrange(len(self.points) + 1)
        if at == len(self.points):
            return rng.random()
        while True:
            u = rng.gauss(self.points[at], self.widths[at])
            if 0 <= u < 1:
                return u


def suggest(space: dict, finished: Sequence[tuple[dict, float]], n: int, rng: random.Random, n_random: int = N_RANDOM) -> list[dict]:
    """The next ``n`` settings to try, given (settings, error) of the finished trials."""
    out: list[dict] = []
    for _ in range(n):
        if len(finished) < n_random:
            out.append({k: _from_line(k, rng.random(), space) for k in space})
            continue
        ranked = [p for p, _ in sorted(finished, key=lambda t: t[1])]
        cut = max(1, math.ceil(GOOD_SHARE * len(ranked)))
        chosen = {}
        for k in space:
            good = Parzen([_to_line(k, p[k], space) for p in ranked[:cut]])
            bad = Parzen([_to_line(k, p[k], space) for p in [*ranked[cut:], *out]])
            chosen[k] = _from_line(k, max((good.draw(rng) for _ in range(N_CANDIDATES)), key=lambda u: good.density(u) / bad.density(u)), space)
        out.append(chosen)
    return out


def tpe_search(train: DataFrame, test: DataFrame, target: str, *, key_cols: Sequence[str], space: dict = SEARCH_SPACE,
               n_trials: int = N_TRIALS, batch: int = 5, patience: int = PATIENCE, n_random: int = N_RANDOM, seed: int = RANDOM_SEED,
               features_col: str = "features") -> tuple[DataFrame, DataFrame, dict[str, BoostModel]]:
    """(trials, predictions, models).

    Fits on ``train``; the error is the least RMSE of any prefix on a fixed sample of ``test`` (15 % of its rows, 40 at
    least). Trials: ``(trial, iterations, depth, learning_rate, l2_leaf_reg, rmse, n_trees)``, best first. Predictions:
    ``(key…, trial, y, prediction)`` of every trial on the sample, written to the shared folder.
    """
    spark: SparkSession = train.sparkSession
    n_valid = max(MIN_VALID, int(VALID_FRAC * test.count()))
    valid = sample_n(test.select(*key_cols, features_col, target), n_valid, key_cols=list(key_cols), seed=seed)
    rows = train.select(*key_cols, features_col, target).withColumn("_valid", F.lit(False)).unionByName(
        valid.select(*key_cols, features_col, target).withColumn("_valid", F.lit(True)))
    data = prepare_rows(rows, [target], features_col=features_col, valid_col="_valid", key_cols=key_cols)
    rng = random.Random(seed)
    finished: list[tuple[dict, float]] = []
    models: dict[str, BoostModel] = {}
    try:
        while len(finished) < n_trials:
            settings = suggest(space, finished, min(batch, n_trials - len(finished)), rng, n_random)
            members = [Member(str(len(finished) + i), (target,), early_stopping_rounds=patience, **p) for i, p in enumerate(settings)]
            grown = grow_members(data, members)
            models.update(grown)
            finished += [(p, min(grown[m.name].staged)) for m, p in zip(members, settings)]
    finally:
        data.release()
    out = valid.select(*key_cols, features_col, F.col(target).alias("y"))
    for name, m in models.items():
        out = m.predict(out, [f"_t{name}"], features_col=features_col)
    cells = F.array(*[F.struct(F.lit(int(name)).alias("trial"), F.col(f"_t{name}").alias("prediction")) for name in models])
    path = os.path.join(checkpoint_dir(spark), f"search-{uuid.uuid4().hex}")
    out.select(*key_cols, "y", F.inline(cells)).write.parquet(path)
    table = spark.createDataFrame([(i, int(p["iterations"]), int(p["depth"]), float(p["learning_rate"]), float(p["l2_leaf_reg"]), float(e), len(models[str(i)].trees))
                                   for i, (p, e) in enumerate(finished)],
                                  "trial int, iterations int, depth int, learning_rate double, l2_leaf_reg double, rmse double, n_trees int")
    return table.orderBy("rmse", "trial"), spark.read.parquet(path), models
