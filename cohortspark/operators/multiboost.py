"""Boosted trees with vector leaves (M7, M8, M9, M15, M24): one tree serves all targets of an ensemble.

Trees are symmetric: a level asks one question (``feature > cut``) of every
node, so a tree of depth d is d questions and a table of 2^d leaves, each a
vector with one value per target, ``rate * G / (W + l2)`` (G: summed
residuals, W: rows, or summed p(1 - p) for the logistic loss).

A level is one job: every task adds the residuals of its rows into a histogram
by (node, feature, bin), the histograms are summed by blocks of features, each
block finds its best cut, and one row per ensemble and block reaches the driver. Several
ensembles (:class:`Member`: the main model, both halves of every hurdle, the
trials of a search) grow in the same passes, so a training run takes as many
jobs as its deepest and longest member, not their sum.

Rows are kept as one byte per feature (its bin) beside the targets and the
raw predictions of the trees grown so far. Every ``REFRESH`` trees the
predictions are brought up to date and the rows are written to the shared
folder, which bounds what a pass has to recompute and cuts the lineage; the
same moment gives the validation error after every tree (``staged errors``), on which
``early_stopping_rounds`` acts: a stopped model keeps the trees up to its best round.

Cuts: a feature with at most ``max_bins`` distinct values is cut at each of
them; others at approximate quantiles. Equal gains (to 10 digits): the lower
feature, then the lower cut. A level that gains nothing ends the tree; a tree without a question ends the ensemble.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.session import checkpoint_dir

REFRESH = 16
BLOCK = 32                   # features whose histograms are summed in one group
CHUNK = 1 << 19              # (row, feature) pairs handled at a time
ROWS_PER_PARTITION = 4096
MAX_PARTITIONS = 4096        # below 5 million rows a partition; more beyond that
SALTS = 32


@dataclass(frozen=True)
class Member:
    """One ensemble: its targets, the rows it learns from, its sizes."""
    name: str
    targets: tuple[str, ...]
    iterations: int = 100
    depth: int = 6
    learning_rate: float = 0.05
    l2_leaf_reg: float = 3.0
    loss: str = "rmse"                       # "logloss": one target, label = target > positive_above
    positive_above: float = 0.0
    only_positive: bool = False              # learn from rows with target > positive_above only
    early_stopping_rounds: int | None = None

    def __post_init__(self):
        if self.loss not in ("rmse", "logloss"):
            raise ValueError(f"unknown loss {self.loss!r}")
        if (self.loss == "logloss" or self.only_positive) and len(self.targets) != 1:
            raise ValueError("a presence or positive-only ensemble has one target")
        if not 0 <= self.depth <= 12 or self.iterations < 0 or self.l2_leaf_reg < 0:
            raise ValueError("depth must be 0 to 12; iterations and l2_leaf_reg cannot be negative")


def member_of(name: str, targets: Sequence[str], params: dict, **kwargs) -> Member:
    """A member from a settings dictionary (unknown settings are an error)."""
    known = {"iterations", "depth", "learning_rate", "l2_leaf_reg", "early_stopping_rounds"}
    if set(params) - known:
        raise ValueError(f"unknown settings {sorted(set(params) - known)}")
    return Member(name, tuple(targets), **params, **kwargs)


@dataclass
class Tree:
    features: list[int]
    codes: list[int]         # right where bin > code
    cuts: list[float]        # the same question on raw values: right where x > cut
    leaves: np.ndarray       # (2^depth, targets)
    cover: np.ndarray        # rows (or summed hessians) of each leaf

    def leaf_of(self, bits: np.ndarray) -> np.ndarray:
        """Leaf numbers from the answers (rows, questions)."""
        return bits @ (1 << np.arange(bits.shape[1])) if bits.shape[1] else np.zeros(len(bits), np.int64)

    def predict_bins(self, bins: np.ndarray) -> np.ndarray:
        return self.leaves[self.leaf_of(bins[:, self.features] > np.array(self.codes, np.int64))]


@dataclass
class BoostModel:
    """A fitted ensemble; iterating over it gives its targets."""
    targets: list[str]
    loss: str
    base: np.ndarray
    trees: list[Tree] = field(default_factory=list)
    staged: list[float] = field(default_factory=list)    # validation error after 0, 1, 2 ... trees

    def __iter__(self):
        return iter(self.targets)

    def __len__(self):
        return len(self.targets)

    @property
    def best_round(self) -> int:
        """Number of trees with the least validation error (the first of equals)."""
        return int(np.argmin(self.staged)) if self.staged else len(self.trees)

    def truncated(self, n_trees: int) -> BoostModel:
        return BoostModel(self.targets, self.loss, self.base, self.trees[:n_trees], self.staged)

    def raw_values(self, x: np.ndarray, stages: bool = False):
        """Raw predictions of feature rows; with ``stages`` after every tree, as (trees + 1, rows, targets)."""
        out = np.tile(self.base, (len(x), 1))
        steps = [out.copy()] if stages else None
        for t in self.trees:
            out += t.leaves[t.leaf_of(x[:, t.features] > np.array(t.cuts))]
            if stages:
                steps.append(out.copy())
        return np.stack(steps) if stages else out

    def predict(self, df: DataFrame, out_cols: Sequence[str], *, features_col: str = "features") -> DataFrame:
        """Append the predictions (probabilities for the logistic loss): one Arrow pass, no shuffle."""
        model, logistic = self, self.loss == "logloss"

        @F.pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            out = model.raw_values(np.stack(x.to_numpy())) if len(x) else np.zeros((0, 1))
            return pd.Series(list(1 / (1 + np.exp(-out)) if logistic else out))

        names = list(out_cols)
        tmp = f"_boost_{uuid.uuid4().hex[:8]}"
        out = df.withColumn(tmp, score(vector_to_array(F.col(features_col))))
        return out.withColumns({c: F.col(tmp)[i] for i, c in enumerate(names)}).drop(tmp)

    def predict_stages(self, df: DataFrame, out_col: str, *, features_col: str = "features") -> DataFrame:
        """Append ``array<array<double>>``: the raw predictions after 0, 1, 2 ... trees."""
        model = self

        @F.pandas_udf("array<array<double>>")
        def score(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series([[list(map(float, s)) for s in row] for row in model.raw_values(np.stack(x.to_numpy()), True).transpose(1, 0, 2)])
        return df.withColumn(out_col, score(vector_to_array(F.col(features_col))))

    def save(self, spark: SparkSession, path: str) -> None:
        """Two small Parquet tables (bounded by trees x leaves)."""
        spark.createDataFrame([(self.targets, self.loss, self.base.tolist(), [float(s) for s in self.staged])],
                              "targets array<string>, loss string, base array<double>, staged array<double>").coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "meta"))
        rows = [(i, t.features, t.codes, t.cuts, t.leaves.ravel().tolist(), t.cover.tolist()) for i, t in enumerate(self.trees)]
        spark.createDataFrame(rows, "tree int, features array<int>, codes array<int>, cuts array<double>, leaves array<double>, cover array<double>") \
            .coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "trees"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostModel:
        m = spark.read.parquet(os.path.join(path, "meta")).first()
        k = len(m["targets"])
        trees = [Tree(list(r["features"]), list(r["codes"]), list(r["cuts"]), np.array(r["leaves"]).reshape(-1, k), np.array(r["cover"]))
                 for r in spark.read.parquet(os.path.join(path, "trees")).orderBy("tree").collect()]
        return cls(list(m["targets"]), m["loss"], np.array(m["base"]), trees, list(m["staged"]))


# --------------------------------------------------------------------------- cuts and bins

def feature_cuts(df: DataFrame, x_col: str, n_features: int, max_bins: int = 32) -> list[np.ndarray]:
    """Ascending cuts of every feature of an ``array<double>`` column (a question is ``x > cut``)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0)] * n_features
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, n_features)
            # one value more than max_bins is enough to know that there are many
            seen = [np.unique(np.concatenate([s, np.unique(x[:, f])]))[:max_bins + 1] for f, s in enumerate(seen)]
        yield pa.RecordBatch.from_pydict({"f": pa.array(range(n_features), pa.int32()), "v": pa.array([s.tolist() for s in seen], pa.list_(pa.float64()))})

    # a task that has met more than max_bins values of a feature has sent enough to tell
    values = df.select(x_col).mapInArrow(part, "f int, v array<double>").select("f", F.explode("v").alias("v")).distinct().persist()
    few = values.groupBy("f").count().where(F.col("count") <= max_bins)
    cuts: list[np.ndarray | None] = [None] * n_features
    for r in values.join(few, "f").groupBy("f").agg(F.sort_array(F.collect_set("v")).alias("v")).collect():  # max_bins numbers a feature at most
        cuts[r["f"]] = np.array(r["v"][:-1])
    values.unpersist()
    many = [f for f, c in enumerate(cuts) if c is None]
    if many:
        at = [i / max_bins for i in range(max_bins)]
        r = df.agg(*[F.percentile_approx(F.col(x_col)[f], at, 10_000).alias(f"q{f}") for f in many], *[F.max(F.col(x_col)[f]).alias(f"m{f}") for f in many]).first()
        for f in many:
            c = np.unique(np.array(r[f"q{f}"]))
            cuts[f] = c[c < r[f"m{f}"]]
    return cuts


def bin_rows(df: DataFrame, x_col: str, cuts: list[np.ndarray]) -> DataFrame:
    """Replace the ``array<double>`` column by ``bins``: one byte per feature (the number of cuts below the value)."""
    rest = [c for c in df.columns if c != x_col]
    shared = df.sparkSession.sparkContext.broadcast(cuts)  # at most max_bins numbers a feature
    n = len(cuts)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(batch.schema.get_field_index(x_col)).flatten()).reshape(-1, n)
            out = np.zeros(x.shape, np.uint8)
            for f, c in enumerate(shared.value):
                out[:, f] = np.searchsorted(c, x[:, f], "left")
            flat = out.tobytes()
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in rest],
                                              pa.array([flat[i * n:(i + 1) * n] for i in range(len(out))], pa.binary())], names=[*rest, "bins"])

    types = dict(df.dtypes)
    return df.mapInArrow(part, ", ".join([*[f"`{c}` {types[c]}" for c in rest], "bins binary"]))


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    """A list or binary column of fixed width as a matrix."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)
    return np.asarray(column.flatten(), dtype).reshape(len(column), width)


# --------------------------------------------------------------------------- growing

@dataclass
class _Growing:
    """Driver-side state of a member: finished trees and the questions of the tree in work."""
    member: Member
    slots: list[int]                 # its targets among all targets
    at: int                          # first of its columns among the raw predictions
    base: np.ndarray
    trees: list[Tree] = field(default_factory=list)
    fresh: int = 0                   # trees that the stored predictions already hold
    features: list[int] = field(default_factory=list)
    codes: list[int] = field(default_factory=list)
    sums: np.ndarray | None = None   # (leaves, targets + 1) of the tree in work
    staged: list[float] = field(default_factory=list)
    over: bool = False
    offset: int = 0                  # trees left out of a copy that is sent to the tasks

    def to_send(self) -> _Growing:
        """A copy without the trees that the stored predictions hold."""
        return replace(self, trees=self.trees[self.fresh - self.offset:], offset=self.fresh, staged=[])

    @property
    def width(self) -> int:
        return len(self.slots)

    def model(self) -> BoostModel:
        return BoostModel(list(self.member.targets), self.member.loss, self.base, list(self.trees), list(self.staged))

    def truth(self, y: np.ndarray) -> np.ndarray:
        y = y[:, self.slots]
        return (y > self.member.positive_above).astype(float) if self.member.loss == "logloss" else y

    def learns(self, y: np.ndarray, valid: np.ndarray) -> np.ndarray:
        on = ~valid
        return on & (y[:, self.slots[0]] > self.member.positive_above) if self.member.only_positive else on

    def raw(self, bins: np.ndarray, pred: np.ndarray) -> np.ndarray:
        out = pred[:, self.at:self.at + self.width].copy()
        for t in self.trees[self.fresh - self.offset:]:
            out += t.predict_bins(bins)
        return out


def _histograms(grow: list[_Growing], n_bins: np.ndarray, n_targets: int, pred_width: int):
    """A function that turns batches of rows into summed histograms, one row per (member, block of features)."""
    grow = [g.to_send() for g in grow]
    begin = np.concatenate([[0], np.cumsum(n_bins)])
    n_features, total = len(n_bins), int(begin[-1])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        sums = [np.zeros((g.width + 1, total << len(g.features))) for g in grow]
        for batch in batches:
            if not batch.num_rows:
                continue
            all_bins = _matrix(batch.column("bins"), np.uint8, n_features)
            y, pred = _matrix(batch.column("y"), float, n_targets), _matrix(batch.column("pred"), float, pred_width)
            valid = np.asarray(batch.column("valid"), bool)
            for g, s in zip(grow, sums):
                rows = np.flatnonzero(g.learns(y, valid))
                bins = all_bins[rows]
                raw = g.raw(bins, pred[rows])
                truth = g.truth(y[rows])
                if g.member.loss == "logloss":
                    p = 1 / (1 + np.exp(-raw))
                    weights = [(truth - p)[:, 0], (p * (1 - p))[:, 0]]
                else:
                    weights = [*(truth - raw).T, None]
                node = np.zeros(len(rows), np.int64)
                for j, (f, c) in enumerate(zip(g.features, g.codes)):
                    node |= (bins[:, f] > c).astype(np.int64) << j
                step = max(1, CHUNK // n_features)
                for lo in range(0, len(rows), step):
                    cell = (bins[lo:lo + step] + begin[:-1] + node[lo:lo + step, None] * total).ravel()
                    for k, w in enumerate(weights):
                        w = None if w is None else np.repeat(w[lo:lo + step], n_features)
                        s[k] += np.bincount(cell, w, s.shape[1])
        salt = TaskContext.get().partitionId() % SALTS
        out = {"member": [], "block": [], "salt": [], "sums": []}
        for i, (g, s) in enumerate(zip(grow, sums)):
            cube = s.reshape(g.width + 1, 1 << len(g.features), total)
            for b, lo in enumerate(range(0, n_features, BLOCK)):
                out["member"].append(i)
                out["block"].append(b)
                out["salt"].append(salt)
                out["sums"].append(np.ascontiguousarray(cube[:, :, begin[lo]:begin[min(lo + BLOCK, n_features)]]).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out["member"], pa.int32()), pa.array(out["block"], pa.int32()), pa.array(out["salt"], pa.int32()),
                                          pa.array(out["sums"], pa.binary())], names=list(out))
    return part


def _added(blobs) -> np.ndarray:
    total = None
    for b in blobs:
        a = np.frombuffer(b, float)
        total = a.copy() if total is None else total.__iadd__(a)
    return total


def best_cut(cube: np.ndarray, n_bins: Sequence[int], l2: float) -> tuple[float, int, int, np.ndarray] | None:
    """(gain, feature, code, sums of the leaves after the cut) over features laid side by side in ``cube`` (targets + 1, nodes, bins)."""
    best = None
    lo = 0

    def worth(s: np.ndarray) -> np.ndarray:
        w = s[-1] + l2
        return ((s[:-1] ** 2) / np.where(w > 0, w, 1)).sum(0)
    for f, n in enumerate(n_bins):
        part = cube[:, :, lo:lo + n]
        lo += n
        if n < 2:
            continue
        left = np.cumsum(part, 2)
        whole = left[:, :, -1:]
        left = left[:, :, :-1]
        gain = (worth(left) + worth(whole - left) - worth(whole)).sum(0)
        gain = np.array([float(f"{g:.9e}") for g in gain])  # equal gains stay equal whatever the order of addition
        code = int(gain.argmax())
        if best is None or gain[code] > best[0]:
            a = left[:, :, code]
            best = (float(gain[code]), f, code, np.concatenate([a, whole[:, :, 0] - a], 1).T)
    return best


def _grow_level(rows: DataFrame, grow: list[_Growing], n_bins: np.ndarray, n_targets: int, pred_width: int, two_stages: bool) -> dict[int, tuple]:
    """Best cut of every growing member: {index: (gain, feature, code, leaf sums)}."""
    part = _histograms(grow, n_bins, n_targets, pred_width)
    partial = rows.select("bins", "y", "pred", "valid").mapInArrow(part, "member int, block int, salt int, sums binary")
    if two_stages:
        def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"member": [key[0]], "block": [key[1]], "salt": [0], "sums": [_added(pdf["sums"]).tobytes()]})
        partial = partial.groupBy("member", "block", "salt").applyInPandas(add, "member int, block int, salt int, sums binary")
    sizes = [(g.width, len(g.features), g.member.l2_leaf_reg) for g in grow]

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        width, level, l2 = sizes[key[0]]
        mine = n_bins[key[1] * BLOCK:(key[1] + 1) * BLOCK]
        found = best_cut(_added(pdf["sums"]).reshape(width + 1, 1 << level, int(mine.sum())), mine, l2)
        if found is None:
            return pd.DataFrame({"member": [], "gain": [], "f": [], "c": [], "sums": []})
        gain, f, code, sums = found
        return pd.DataFrame({"member": [key[0]], "gain": [gain], "f": [-(key[1] * BLOCK + f)], "c": [-code], "sums": [np.ascontiguousarray(sums).tobytes()]})

    cuts = partial.groupBy("member", "block").applyInPandas(choose, "member int, gain double, f int, c int, sums binary")
    best: dict[int, tuple] = {}
    for r in cuts.collect():  # one row per member and block of features
        here = (r["gain"], r["f"], r["c"])
        if r["member"] not in best or here > best[r["member"]][:3]:
            best[r["member"]] = (*here, r["sums"])
    return {m: (gain, -f, -c, np.frombuffer(sums, float).reshape(-1, sizes[m][0] + 1)) for m, (gain, f, c, sums) in best.items()}


def _finish_tree(g: _Growing, cuts: list[np.ndarray]) -> None:
    w = g.sums[:, -1:] + g.member.l2_leaf_reg
    leaves = g.member.learning_rate * g.sums[:, :-1] / np.where(w > 0, w, 1)
    g.trees.append(Tree(g.features, g.codes, [float(cuts[f][c]) for f, c in zip(g.features, g.codes)], leaves, g.sums[:, -1].copy()))
    g.features, g.codes, g.sums = [], [], None


def _staged_sums(grow: list[_Growing], n_features: int, n_targets: int, pred_width: int):
    """Validation loss sums of every tree that the stored predictions do not hold yet."""
    grow = [g.to_send() for g in grow]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple[int, int], list[float]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = _matrix(batch.column("bins"), np.uint8, n_features)
            y, pred = _matrix(batch.column("y"), float, n_targets), _matrix(batch.column("pred"), float, pred_width)
            for i, g in enumerate(grow):
                on = g.learns(y, np.zeros(len(y), bool))
                raw, truth = pred[on, g.at:g.at + g.width].copy(), g.truth(y[on])
                for r in range(g.fresh, g.fresh + len(g.trees) + 1):
                    if r > g.fresh:
                        raw += g.trees[r - 1 - g.fresh].predict_bins(bins[on])
                    loss = np.logaddexp(0, np.where(truth > 0, -raw, raw)).sum() if g.member.loss == "logloss" else ((truth - raw) ** 2).sum()
                    cell = out.setdefault((i, r), [0.0, 0])
                    cell[0] += float(loss)
                    cell[1] += len(raw)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.int32()), pa.array([k[1] for k in out], pa.int32()),
                                          pa.array([v[0] for v in out.values()], pa.float64()), pa.array([v[1] for v in out.values()], pa.int64())],
                                         names=["member", "round", "loss", "n"])
    return part


def _evaluate(rows: DataFrame, grow: list[_Growing], n_features: int, n_targets: int, pred_width: int) -> None:
    part = _staged_sums(grow, n_features, n_targets, pred_width)
    sums = rows.where("valid").select("bins", "y", "pred").mapInArrow(part, "member int, round int, loss double, n long")
    for r in sums.groupBy("member", "round").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).orderBy("member", "round").collect():
        g = grow[r["member"]]
        if r["round"] == len(g.staged):
            mean = r["loss"] / r["n"]
            g.staged.append(float(mean if g.member.loss == "logloss" else np.sqrt(mean)))


def _refresh(rows: DataFrame, grow: list[_Growing], n_features: int, pred_width: int) -> DataFrame:
    """Rows with the predictions of all finished trees, written to the shared folder."""
    sent = [g.to_send() for g in grow]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, pred = _matrix(batch.column("bins"), np.uint8, n_features), _matrix(batch.column("pred"), float, pred_width).copy()
            for g in sent:
                pred[:, g.at:g.at + g.width] = g.raw(bins, pred)
            at = batch.schema.get_field_index("pred")
            yield batch.set_column(at, "pred", pa.ListArray.from_arrays(np.arange(0, pred.size + 1, pred_width, dtype=np.int32), pa.array(pred.ravel())))

    out = _stored(rows.mapInArrow(part, rows.schema))
    rows.unpersist()
    for g in grow:
        g.fresh = len(g.trees)
    return out


def _stored(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder, kept in memory where it fits."""
    path = os.path.join(checkpoint_dir(df.sparkSession), f"boost-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).persist()


@dataclass
class BoostRows:
    """Binned rows that ensembles can be grown on, one after the other; ``release`` them at the end."""
    rows: DataFrame          # bins, y, valid
    targets: list[str]
    cuts: list[np.ndarray]
    n_learn: int
    has_valid: bool

    def release(self) -> None:
        self.rows.unpersist()


def prepare_rows(train: DataFrame, targets: Sequence[str], *, features_col: str = "features", valid_col: str | None = None,
                 key_cols: Sequence[str] | None = None, max_bins: int = 32) -> BoostRows:
    """Bin the features and write the rows. Rows marked by ``valid_col`` are only evaluated; null marks learn, null targets are an error."""
    if not 2 <= max_bins <= 255:
        raise ValueError("max_bins must be 2 to 255")
    targets = list(targets)
    valid = F.coalesce(F.col(valid_col).cast("boolean"), F.lit(False)) if valid_col else F.lit(False)
    data = train.select(*(key_cols or []), vector_to_array(F.col(features_col)).alias("x"), F.array(*[F.col(f"`{t}`").cast("double") for t in targets]).alias("y"), valid.alias("valid"))
    learn = data.where(~F.col("valid"))
    facts = learn.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"), F.count_if(F.exists("y", lambda v: v.isNull())).alias("empty")).first()
    n = facts["n"]
    if not n:
        raise ValueError("no rows to learn from")
    if facts["empty"]:
        raise ValueError(f"{facts['empty']} rows have a null target")
    cuts = feature_cuts(learn, "x", facts["width"], max_bins)
    parts = max(1, min(-(-n // ROWS_PER_PARTITION), max(MAX_PARTITIONS, n // 5_000_000)))
    binned = bin_rows(data, "x", cuts)  # before the shuffle: a byte a feature travels, no double
    if key_cols:
        binned = binned.repartition(parts, *key_cols).sortWithinPartitions(*key_cols)
    rows = _stored(binned.select("bins", "y", "valid"))
    return BoostRows(rows, targets, cuts, n, bool(valid_col) and not rows.where("valid").isEmpty())


def grow_members(data: BoostRows, members: Sequence[Member]) -> dict[str, BoostModel]:
    """Grow all members together on prepared rows."""
    if len({m.name for m in members}) != len(members):
        raise ValueError("members need different names")
    targets, cuts = data.targets, data.cuts
    n_features = len(cuts)
    n_bins = np.array([len(c) + 1 for c in cuts])
    learn = data.rows.where(~F.col("valid"))
    stats = learn.agg(*[F.avg(_label(m, targets, t)).alias(f"m{i}_{j}") for i, m in enumerate(members) for j, t in enumerate(m.targets)]).first()
    grow, at = [], 0
    for i, m in enumerate(members):
        mean = np.array([stats[f"m{i}_{j}"] if stats[f"m{i}_{j}"] is not None else 0.0 for j in range(len(m.targets))])
        if m.loss == "logloss":
            p = np.clip(mean, 1e-6, 1 - 1e-6)
            mean = np.log(p / (1 - p))
        grow.append(_Growing(m, [targets.index(t) for t in m.targets], at, mean))
        at += len(m.targets)
    rows = data.rows.withColumn("pred", F.array(*[F.lit(float(v)) for g in grow for v in g.base]))
    shape = (len(targets), at)
    two_stages = -(-data.n_learn // ROWS_PER_PARTITION) > 64
    try:
        while True:
            for g in grow:
                g.over |= len(g.trees) >= g.member.iterations
            live = [g for g in grow if not g.over]
            pending = max((len(g.trees) - g.fresh for g in grow), default=0)
            if data.has_valid and (pending >= REFRESH or not live):
                _evaluate(rows, grow, n_features, *shape)
                for g in live:
                    wait = g.member.early_stopping_rounds
                    g.over |= wait is not None and len(g.trees) - int(np.argmin(g.staged)) >= wait
                live = [g for g in live if not g.over]
            if not live:
                break
            if pending >= REFRESH:
                rows = _refresh(rows, grow, n_features, at)
            found = _grow_level(rows, live, n_bins, *shape, two_stages)
            for i, g in enumerate(live):
                gain, f, code, sums = found.get(i, (0.0, 0, 0, None))
                if gain > 0 and len(g.features) < g.member.depth:
                    g.features, g.codes, g.sums = [*g.features, f], [*g.codes, code], sums
                    if len(g.features) == g.member.depth:
                        _finish_tree(g, cuts)
                elif g.features:
                    _finish_tree(g, cuts)
                else:
                    g.over = True
    finally:
        rows.unpersist()
    out = {}
    for g in grow:
        model = g.model()
        out[g.member.name] = model.truncated(model.best_round) if data.has_valid and g.member.early_stopping_rounds is not None else model
    return out


def fit_members(train: DataFrame, members: Sequence[Member], *, features_col: str = "features", valid_col: str | None = None,
                key_cols: Sequence[str] | None = None, max_bins: int = 32) -> dict[str, BoostModel]:
    """Prepare the rows, grow all members together, release the rows."""
    targets = list(dict.fromkeys(t for m in members for t in m.targets))
    data = prepare_rows(train, targets, features_col=features_col, valid_col=valid_col, key_cols=key_cols, max_bins=max_bins)
    try:
        return grow_members(data, members)
    finally:
        data.release()


def _label(m: Member, targets: list[str], t: str) -> Column:
    y = F.col("y")[targets.index(t)]
    if m.loss == "logloss":
        return (y > m.positive_above).cast("double")
    return F.when(y > m.positive_above, y) if m.only_positive else y


def staged_errors(df: DataFrame, model: BoostModel, *, features_col: str = "features", by: Sequence[str] = ()) -> DataFrame:
    """``(by…, round, rmse)``: error over all targets after 0, 1, 2 ... trees, from one scoring pass of the rows."""
    truth = F.array(*[F.col(f"`{t}`").cast("double") for t in model.targets])
    scored = model.predict_stages(df.select(*by, features_col, truth.alias("_y")), "_s", features_col=features_col)
    squared = F.transform("_s", lambda s: F.aggregate(F.zip_with("_y", s, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, v: x + v))
    return (scored.select(*by, F.posexplode(squared).alias("round", "sq")).groupBy(*by, "round").agg(F.sqrt(F.avg("sq")).alias("rmse")))
