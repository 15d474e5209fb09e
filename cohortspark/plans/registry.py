"""Registered queries: name → (Spark callable, DuckDB oracle SQL or None).

Every callable takes ``(spark, sf_dir)``, reads the given tables (or data
Spark derives from them) and returns a DataFrame whose columns are aliased
exactly like the oracle's. Doubles are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions.text import merge_text
from cohortspark.operators import clean as clean_ops
from cohortspark.operators.geo import derive_geography, state_region_rollup
from cohortspark.operators.ood import (
    fit_mahalanobis, fit_ood_stats, flag_counts, flag_ood, mahalanobis, score_ood,
)
from cohortspark.operators.split import assign_split, sample_n, split_sizes
from cohortspark.plans import oracle_sql as O
from cohortspark.plans.ood_job import ood_report
from cohortspark.plans.prepare import cleaned_trials, split_trials
from cohortspark.schema import CAT_COLS, OOD_COLS, TEXT_COLS
from cohortspark.sources.readers import read_table
from cohortspark.sources.trials_view import trials_view, write_trials

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
ROW_KEY = ["row_id", "copy_no"]


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


@F.pandas_udf(T.StructType([T.StructField("n_nonzero", T.LongType()), T.StructField("l1", T.DoubleType()),
                            T.StructField("l2sq", T.DoubleType()), T.StructField("weighted", T.DoubleType())]))
def _vector_fingerprint(v: pd.Series) -> pd.DataFrame:
    """Exact summary of dense vectors: non-zeros, L1, L2², (index+1)-weighted sum."""
    m = np.vstack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, 1))
    idx = np.arange(1, m.shape[1] + 1, dtype=np.float64)
    return pd.DataFrame({"n_nonzero": (m != 0).sum(axis=1).astype(np.int64), "l1": np.abs(m).sum(axis=1),
                         "l2sq": (m * m).sum(axis=1), "weighted": m @ idx})


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def r6(x: str) -> str:
    return f"round({x}, 6)"


# --------------------------------------------------------------------------- cleaning

@register("parse_age", O.cleaned_cte() + """
SELECT row_id, copy_no, round(pmin, 6) AS min_age_years, round(pmax, 6) AS max_age_years FROM parsed""")
def q_parse_age(spark, sf_dir):
    t = clean_ops.with_parsed(trials_view(spark, sf_dir))
    return t.select(*ROW_KEY, F.col("_pmin").alias("min_age_years"), F.col("_pmax").alias("max_age_years"))


@register("clean_ages", O.cleaned_cte() + """
SELECT row_id, copy_no, round(eligibility_min_age_yrs, 6) AS eligibility_min_age_yrs,
       round(eligibility_max_age_yrs, 6) AS eligibility_max_age_yrs, min_age_missing, max_age_missing
FROM cleaned""")
def q_clean_ages(spark, sf_dir):
    c = clean_ops.clean_trials(trials_view(spark, sf_dir))
    return c.select(*ROW_KEY, "eligibility_min_age_yrs", "eligibility_max_age_yrs",
                    "min_age_missing", "max_age_missing")


@register("clean_categoricals", O.cleaned_cte() + f"""
SELECT row_id, copy_no, {", ".join(CAT_COLS)} FROM cleaned""")
def q_clean_categoricals(spark, sf_dir):
    c = clean_ops.clean_trials(trials_view(spark, sf_dir))
    return c.select(*ROW_KEY, *CAT_COLS)


@register("clean_text", O.cleaned_cte() + f"""
SELECT row_id, copy_no, {", ".join(TEXT_COLS)} FROM cleaned""")
def q_clean_text(spark, sf_dir):
    c = clean_ops.clean_trials(trials_view(spark, sf_dir))
    return c.select(*ROW_KEY, *TEXT_COLS)


@register("merge_text", O.cleaned_cte() + f"""
SELECT row_id, copy_no, {O.merge_text_sql(TEXT_COLS, O.TRIALS_PRESENT_TEXT)} AS merged_text FROM trials""")
def q_merge_text(spark, sf_dir):
    t = trials_view(spark, sf_dir)
    return t.select(*ROW_KEY, merge_text([c for c in TEXT_COLS if c in t.columns], TEXT_COLS)
                    .alias("merged_text"))


# --------------------------------------------------------------------------- geography

@register("geo_counts", O.cleaned_cte() + """
SELECT row_id, copy_no, array_to_string(us_states, ',') AS us_states, n_sites, n_us_states, n_us_regions
FROM geo""")
def q_geo_counts(spark, sf_dir):
    g = derive_geography(trials_view(spark, sf_dir))
    return g.select(*ROW_KEY, F.array_join("us_states", ",").alias("us_states"),
                    "n_sites", "n_us_states", "n_us_regions")


@register("state_region_rollup", O.cleaned_cte() + f"""
SELECT {O.region_case('state')} AS region, state, count(*) AS n_trials
FROM (SELECT unnest(us_states) AS state FROM geo) GROUP BY ALL""")
def q_state_region_rollup(spark, sf_dir):
    return state_region_rollup(derive_geography(trials_view(spark, sf_dir)))


# --------------------------------------------------------------------------- split

@register("split_exact", O.cleaned_cte() + O.split_cte() + """
SELECT row_id, copy_no, nct_id, split FROM splitted""")
def q_split_exact(spark, sf_dir):
    return split_trials(spark, sf_dir).select(*ROW_KEY, "nct_id", "split")


@register("split_sizes", O.cleaned_cte() + O.split_cte() + """
SELECT split, count(*) AS n_rows, count(DISTINCT coalesce(nct_id, '__null__')) AS n_keys
FROM splitted GROUP BY split""")
def q_split_sizes(spark, sf_dir):
    return split_sizes(split_trials(spark, sf_dir))


@register("split_two_step", O.cleaned_cte() + O.split_cte(variant="two_step") + """
SELECT row_id, copy_no, nct_id, split FROM splitted""")
def q_split_two_step(spark, sf_dir):
    return split_trials(spark, sf_dir, variant="two_step").select(*ROW_KEY, "nct_id", "split")


@register("split_by_row", """
WITH c AS (SELECT c_nationkey, c_mktsegment FROM customer),
r AS (SELECT *, md5('42:' || k) AS h FROM (SELECT *, concat_ws('~', coalesce(CAST(c_nationkey AS VARCHAR), '∅'), coalesce(c_mktsegment, '∅')) AS k FROM c)),
ranked AS (SELECT c_nationkey, c_mktsegment, row_number() OVER (ORDER BY h, k) - 1 AS rn, count(*) OVER () AS n FROM r)
SELECT c_nationkey, c_mktsegment, CASE WHEN rn < round_even(0.64e0 * n, 0) THEN 'train'
  WHEN rn < round_even(0.64e0 * n, 0) + round_even(0.16e0 * n, 0) THEN 'test' ELSE 'holdout' END AS split FROM ranked""")
def q_split_by_row(spark, sf_dir):
    """Rows without a key, most of them repeated, meet the quotas one by one."""
    c = read_table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment")
    return assign_split(c, key_col=None)


@register("sample_n", O.cleaned_cte() + """
SELECT row_id, copy_no, nct_id FROM trials
ORDER BY md5('42:' || concat_ws('~', row_id, copy_no)), concat_ws('~', row_id, copy_no) LIMIT 2000""")
def q_sample_n(spark, sf_dir):
    t = trials_view(spark, sf_dir).select(*ROW_KEY, "nct_id")
    return sample_n(t, 2000, key_cols=ROW_KEY)


# --------------------------------------------------------------------------- OOD

def _ood_stats_sql(source: str, where: str, std: str, fix: str) -> str:
    parts = []
    for c in OOD_COLS:
        s = f"{std}(CAST({c} AS DOUBLE))"
        parts.append(f"SELECT '{c}' AS col, avg(CAST({c} AS DOUBLE)) AS mean, {fix.format(s=s)} AS std "
                     f"FROM {source} {where}")
    return " UNION ALL ".join(parts)


PKG_FIX = "CASE WHEN {s} IS NULL OR isnan({s}) OR isinf({s}) OR {s} < 1e-12 THEN 1e-12 ELSE {s} END"
NB_FIX = "CASE WHEN {s} = 0 THEN 1e0 ELSE {s} END"


def _ood_scores_sql(stats: str) -> str:
    zs = ", ".join(
        f"abs((coalesce(CAST(g.{c} AS DOUBLE), (SELECT mean FROM st WHERE col = '{c}')) - "
        f"(SELECT mean FROM st WHERE col = '{c}')) / (SELECT std FROM st WHERE col = '{c}'))"
        for c in OOD_COLS)
    return f""", st AS ({stats}),
sc AS (SELECT g.*, coalesce(greatest({zs}), 0e0) AS ood_score FROM splitted g)
"""


@register("ood_stats", O.cleaned_cte() + O.split_cte() + """
SELECT col, round(mean, 6) AS mean, round(std, 6) AS std FROM (""" +
          _ood_stats_sql("splitted", "WHERE split = 'train'", "stddev_pop", PKG_FIX) + ")")
def q_ood_stats(spark, sf_dir):
    s = split_trials(spark, sf_dir)
    return fit_ood_stats(s.where(F.col("split") == "train"), OOD_COLS)


@register("ood_scores", O.cleaned_cte() + O.split_cte() +
          _ood_scores_sql(_ood_stats_sql("splitted", "WHERE split = 'train'", "stddev_pop", PKG_FIX)) +
          """SELECT row_id, copy_no, nct_id, split, round(ood_score, 6) AS ood_score,
  ood_score >= 2e0 AS ood_warn, ood_score >= 3e0 AS ood_crit FROM sc""")
def q_ood_scores(spark, sf_dir):
    return ood_report(split_trials(spark, sf_dir)).select(
        *ROW_KEY, "nct_id", "split", "ood_score", "ood_warn", "ood_crit")


@register("ood_flag_counts", O.cleaned_cte() + O.split_cte() +
          _ood_scores_sql(_ood_stats_sql("splitted", "WHERE split = 'train'", "stddev_pop", PKG_FIX)) +
          """SELECT count(*) FILTER (WHERE ood_score >= 2e0) AS n_warn,
  count(*) FILTER (WHERE ood_score >= 3e0) AS n_crit, count(*) AS n_rows FROM sc""")
def q_ood_flag_counts(spark, sf_dir):
    return flag_counts(ood_report(split_trials(spark, sf_dir)))


@register("ood_notebook", O.cleaned_cte() + O.split_cte() +
          _ood_scores_sql(_ood_stats_sql("geo", "", "stddev_samp", NB_FIX)) +
          """SELECT row_id, copy_no, round(ood_score, 6) AS ood_score,
  ood_score >= 2e0 AS ood_warn, ood_score >= 3e0 AS ood_crit FROM sc""")
def q_ood_notebook(spark, sf_dir):
    g = cleaned_trials(spark, sf_dir)
    stats = fit_ood_stats(g, OOD_COLS, variant="notebook")
    return flag_ood(score_ood(g, stats, OOD_COLS)).select(*ROW_KEY, "ood_score", "ood_warn", "ood_crit")


def _mahalanobis_sql() -> str:
    """Distance as |z| with L z = x - mean, L the Cholesky factor of the train covariance (no inverse, unlike the Spark side).

    A column that the earlier ones determine adds nothing, as in the pseudo-inverse.
    """
    k = range(len(OOD_COLS))
    x = [f"CAST({c} AS DOUBLE)" for c in OOD_COLS]
    stats = [f"avg({x[i]}) AS m{i}" for i in k]
    stats += [f"covar_samp({x[i]}, {x[j]}) AS c{i}_{j}" for i in k for j in k if j <= i]
    factor = []
    for j in k:
        for i in k[j:]:
            rest = f"c{i}_{j}" + "".join(f" - l{i}_{n} * l{j}_{n}" for n in range(j))
            factor.append(f"CASE WHEN {rest} > 1e-9 * c{j}_{j} THEN sqrt({rest}) END AS l{j}_{j}" if i == j
                          else f"coalesce(({rest}) / l{j}_{j}, 0e0) AS l{i}_{j}")
    solved = [f"coalesce((coalesce({x[i]}, m{i}) - m{i}" + "".join(f" - l{i}_{n} * z{n}" for n in range(i)) + f") / l{i}_{i}, 0e0) AS z{i}" for i in k]
    return f""", cv AS (SELECT {", ".join(stats)} FROM splitted WHERE split = 'train'),
ch AS (SELECT *, {", ".join(factor)} FROM cv),
zs AS (SELECT row_id, copy_no, split, {", ".join(solved)} FROM splitted, ch),
ds AS (SELECT row_id, copy_no, split, sqrt({" + ".join(f"z{i} * z{i}" for i in k)}) AS d FROM zs)
"""


@register("mahalanobis", O.cleaned_cte() + O.split_cte() + _mahalanobis_sql() +
          "SELECT row_id, copy_no, split, round(d, 6) AS mahalanobis FROM ds")
def q_mahalanobis(spark, sf_dir):
    s = split_trials(spark, sf_dir)
    model = fit_mahalanobis(s.where(F.col("split") == "train"), OOD_COLS)
    return mahalanobis(s, model).select(*ROW_KEY, "split", "mahalanobis")


# --------------------------------------------------------------------------- targets, metrics, baselines

from cohortspark.operators.baselines import mean_baseline, union_baselines  # noqa: E402
from cohortspark.operators.metrics import (  # noqa: E402
    extract_targets, macro_rmse, metrics_long, metrics_table,
)
from cohortspark.schema import SPARSE_TARGETS, TARGET_COLS  # noqa: E402


def _targets_cte() -> str:
    ys = ", ".join(f"least(greatest(coalesce(CAST({t} AS DOUBLE), 0e0), 0e0), 1e0) AS y_{t}"
                   for t in TARGET_COLS)
    means = ", ".join(f"avg(y_{t}) AS m_{t}" for t in TARGET_COLS)
    return f""", tg AS (SELECT row_id, copy_no, nct_id, split, {ys} FROM splitted),
means AS (SELECT {means} FROM tg WHERE split = 'train')
"""


def _pred_cte(name: str, zero: list[str]) -> str:
    ps = ", ".join(("0e0" if t in zero else f"m_{t}") + f" AS p_{t}" for t in TARGET_COLS)
    return f", {name} AS (SELECT tg.*, {ps} FROM tg, means)\n"


def _long_sql(pred: str) -> str:
    parts = [f"SELECT split, '{t}' AS target, sqrt(avg((y_{t} - least(greatest(p_{t}, 0e0), 1e0)) ^ 2)) AS rmse, "
             f"avg(abs(y_{t} - least(greatest(p_{t}, 0e0), 1e0))) AS mae, count(*) AS n FROM {pred} GROUP BY split"
             for t in TARGET_COLS]
    return " UNION ALL ".join(parts)


def _wide_sql(long_name: str) -> str:
    cols = ", ".join(
        f"round(max(CASE WHEN split = '{s}' THEN {m} END), 6) AS \"{s.capitalize()} {m.upper()}\""
        for s in ("train", "test", "holdout") for m in ("rmse", "mae"))
    return f"SELECT target AS \"Target\", {cols} FROM {long_name} GROUP BY target"


_BASE = O.cleaned_cte() + O.split_cte() + _targets_cte()


def _mean_predictions(spark, sf_dir, zero=()):
    s = extract_targets(split_trials(spark, sf_dir), TARGET_COLS)
    return mean_baseline(s, TARGET_COLS, zero_targets=list(zero))


def _pred_cols():
    return [f"pred_{t}" for t in TARGET_COLS]


@register("targets", _BASE + f"""
SELECT row_id, copy_no, {", ".join(f"round(y_{t}, 6) AS {t}" for t in TARGET_COLS)} FROM tg""")
def q_targets(spark, sf_dir):
    s = extract_targets(cleaned_trials(spark, sf_dir), TARGET_COLS)
    return s.select(*ROW_KEY, *TARGET_COLS)


@register("metrics_long", _BASE + _pred_cte("pm", []) + f"""
SELECT split, target, round(rmse, 6) AS rmse, round(mae, 6) AS mae, n FROM ({_long_sql("pm")})""")
def q_metrics_long(spark, sf_dir):
    return metrics_long(_mean_predictions(spark, sf_dir), TARGET_COLS, _pred_cols())


@register("metrics_table", _BASE + _pred_cte("pm", []) + f", lm AS ({_long_sql('pm')})\n" +
          _wide_sql("lm"))
def q_metrics_table(spark, sf_dir):
    return metrics_table(metrics_long(_mean_predictions(spark, sf_dir), TARGET_COLS, _pred_cols()))


@register("macro_rmse", _BASE + _pred_cte("pm", []) + f", lm AS ({_long_sql('pm')})\n" + """
SELECT split, round(avg(rmse), 6) AS macro_rmse, round(avg(mae), 6) AS macro_mae FROM lm GROUP BY split""")
def q_macro_rmse(spark, sf_dir):
    return macro_rmse(metrics_long(_mean_predictions(spark, sf_dir), TARGET_COLS, _pred_cols()))


@register("baseline_mean", _BASE + _pred_cte("pm", []) + f", lm AS ({_long_sql('pm')})\n" +
          _wide_sql("lm"))
def q_baseline_mean(spark, sf_dir):
    return metrics_table(metrics_long(_mean_predictions(spark, sf_dir), TARGET_COLS, _pred_cols()))


@register("baseline_zero", _BASE + _pred_cte("pz", SPARSE_TARGETS) + f", lz AS ({_long_sql('pz')})\n" +
          _wide_sql("lz"))
def q_baseline_zero(spark, sf_dir):
    p = _mean_predictions(spark, sf_dir, SPARSE_TARGETS)
    return metrics_table(metrics_long(p, TARGET_COLS, _pred_cols()))


@register("baseline_union", _BASE + _pred_cte("pm", []) + _pred_cte("pz", SPARSE_TARGETS) +
          f", lm AS ({_long_sql('pm')}), lz AS ({_long_sql('pz')})\n" +
          f"SELECT 'mean' AS \"Baseline\", * FROM ({_wide_sql('lm')}) UNION ALL "
          f"SELECT 'mean_plus_zero_sparse' AS \"Baseline\", * FROM ({_wide_sql('lz')})")
def q_baseline_union(spark, sf_dir):
    s = extract_targets(split_trials(spark, sf_dir), TARGET_COLS).select("split", *TARGET_COLS).cache()
    tables = {
        "mean": metrics_table(metrics_long(mean_baseline(s, TARGET_COLS), TARGET_COLS, _pred_cols())),
        "mean_plus_zero_sparse": metrics_table(metrics_long(
            mean_baseline(s, TARGET_COLS, zero_targets=SPARSE_TARGETS), TARGET_COLS, _pred_cols())),
    }
    return union_baselines(tables)


# --------------------------------------------------------------------------- kNN baseline

from cohortspark.operators.neighbors import (  # noqa: E402
    knn_label_shares, knn_neighbors, label_share_metrics,
)

KNN_K = 25


def _emb_split(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return assign_split(e, key_col="vec_id")


def _knn_shares(spark, sf_dir):
    e = _emb_split(spark, sf_dir).cache()
    train = e.where(F.col("split") == "train")
    nb = knn_neighbors(e, train, k=KNN_K, id_col="vec_id", vec_col="embedding")
    return e, knn_label_shares(nb, train, id_col="vec_id")


_KNN_BASE = ("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)" +
             O.split_cte(source="e", key="vec_id") + f""",
tr AS (SELECT * FROM splitted WHERE split = 'train'),
pairs AS (SELECT q.vec_id AS q, t.vec_id AS n, t.label,
                 1 - coalesce(list_cosine_similarity(q.v, t.v), 0e0) AS d FROM splitted q, tr t),
nn AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, n) AS rk FROM pairs),
shares AS (SELECT q AS vec_id, label, count(*) / least({KNN_K}, (SELECT count(*) FROM tr)) AS share
           FROM nn WHERE rk <= {KNN_K} GROUP BY q, label)
""")


@register("knn_predict", _KNN_BASE + "SELECT vec_id, label, round(share, 6) AS share FROM shares")
def q_knn_predict(spark, sf_dir):
    _, shares = _knn_shares(spark, sf_dir)
    return shares.select(F.col("q_id").alias("vec_id"), "label", "share")


@register("knn_metrics", _KNN_BASE + """,
truth AS (SELECT vec_id, label, split, 1e0 AS y FROM splitted),
pred AS (SELECT s.vec_id, s.label, t.split, s.share AS p FROM shares s JOIN splitted t USING (vec_id)),
pairs2 AS (SELECT coalesce(t.split, p.split) AS split, coalesce(t.label, p.label) AS label,
                  coalesce(t.y, 0e0) AS y, coalesce(p.p, 0e0) AS p
           FROM truth t FULL OUTER JOIN pred p ON t.vec_id = p.vec_id AND t.label = p.label),
sizes AS (SELECT split, count(*) AS n_split FROM splitted GROUP BY split)
SELECT a.split, 'label_' || CAST(a.label AS VARCHAR) AS target,
       round(sqrt(sum((y - p) ^ 2) / any_value(n_split)), 6) AS rmse,
       round(sum(abs(y - p)) / any_value(n_split), 6) AS mae
FROM pairs2 a JOIN sizes s USING (split) GROUP BY a.split, a.label""")
def q_knn_metrics(spark, sf_dir):
    e, shares = _knn_shares(spark, sf_dir)
    return label_share_metrics(shares, e, id_col="vec_id")


# --------------------------------------------------------------------------- structured features

from cohortspark.operators.features import (  # noqa: E402
    fit_categorical_encoder, level_table, numeric_block, onehot_long,
)
from cohortspark.schema import NUMERIC_COLS  # noqa: E402


def _levels_sql() -> str:
    parts = [f"SELECT DISTINCT '{c}' AS col, {c} AS level, {i} AS col_no FROM geo" for i, c in enumerate(CAT_COLS)]
    return f""", lv AS ({" UNION ALL ".join(parts)}),
lvi AS (SELECT col, level, col_no, CAST(row_number() OVER (PARTITION BY col ORDER BY level) - 1 AS INTEGER) AS idx FROM lv),
lvp AS (SELECT *, CAST(row_number() OVER (ORDER BY col_no, idx) - 1 AS INTEGER) AS position FROM lvi)
"""


@register("category_levels", O.cleaned_cte() + _levels_sql() + "SELECT col, level, idx, position FROM lvp")
def q_category_levels(spark, sf_dir):
    return level_table(cleaned_trials(spark, sf_dir)).drop("n")


@register("onehot_long", O.cleaned_cte() + _levels_sql() + f"""
SELECT g.row_id, g.copy_no, p.col || '_' || p.level AS feature, p.position + {len(NUMERIC_COLS)} AS position,
       1e0 AS value
FROM ({" UNION ALL ".join(f"SELECT row_id, copy_no, '{c}' AS col, {c} AS level FROM geo" for c in CAT_COLS)}) g
JOIN lvp p ON p.col = g.col AND p.level = g.level""")
def q_onehot_long(spark, sf_dir):
    g = cleaned_trials(spark, sf_dir)
    return onehot_long(g, level_table(g), ROW_KEY, num_offset=len(NUMERIC_COLS))


@register("numeric_block", O.cleaned_cte() + f"""
SELECT row_id, copy_no, {", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in NUMERIC_COLS)} FROM geo""")
def q_numeric_block(spark, sf_dir):
    return numeric_block(cleaned_trials(spark, sf_dir)).select(*ROW_KEY, *NUMERIC_COLS)


# --------------------------------------------------------------------------- hurdle algebra and constraints

from cohortspark.operators.hurdle import hurdle_combine, presence_label, sex_renormalize  # noqa: E402


def _hurdle_inputs(spark, sf_dir):
    """Presence probability and conditional amount taken from the given tables:
    p = asian share, y_cond = 2 × aian share (exceeds 1 on some rows)."""
    t = extract_targets(cleaned_trials(spark, sf_dir), TARGET_COLS)
    return t.select(*ROW_KEY, F.col("asian_pct").alias("p"), (F.col("aian_pct") * 2.0).alias("y_cond"),
                    "aian_pct", "nhpi_pct", "male_pct", "female_pct")


_HURDLE_BASE = _BASE + """, hin AS (SELECT row_id, copy_no, y_asian_pct AS p, y_aian_pct * 2e0 AS y_cond,
  y_aian_pct, y_nhpi_pct, y_male_pct, y_female_pct FROM tg)
"""
_YC = "least(greatest(y_cond, 0e0), 1e0)"


@register("hurdle_labels", _HURDLE_BASE + """
SELECT row_id, copy_no, CAST(y_aian_pct > 0 AS INTEGER) AS aian_present, CAST(y_nhpi_pct > 0.05e0 AS INTEGER) AS nhpi_present
FROM hin""")
def q_hurdle_labels(spark, sf_dir):
    h = _hurdle_inputs(spark, sf_dir)
    return h.select(*ROW_KEY, presence_label(F.col("aian_pct")).alias("aian_present"),
                    presence_label(F.col("nhpi_pct"), 0.05).alias("nhpi_present"))


@register("hurdle_soft", _HURDLE_BASE + f"""
SELECT row_id, copy_no, round(least(greatest(p * {_YC}, 0e0), 1e0), 6) AS y_pred, round(p, 6) AS p_present,
       round({_YC}, 6) AS y_cond, p >= 0.5e0 AS present FROM hin""")
def q_hurdle_soft(spark, sf_dir):
    h = _hurdle_inputs(spark, sf_dir)
    return h.select(*ROW_KEY, *[v.alias(k) for k, v in hurdle_combine(F.col("p"), F.col("y_cond")).items()])


@register("hurdle_hard", _HURDLE_BASE + f"""
SELECT row_id, copy_no, round(CASE WHEN p >= 0.5e0 THEN {_YC} ELSE 0e0 END, 6) AS y_pred, round(p, 6) AS p_present,
       round({_YC}, 6) AS y_cond, p >= 0.5e0 AS present FROM hin""")
def q_hurdle_hard(spark, sf_dir):
    h = _hurdle_inputs(spark, sf_dir)
    return h.select(*ROW_KEY, *[v.alias(k) for k, v in
                                hurdle_combine(F.col("p"), F.col("y_cond"), hard_gate=True).items()])


def _renorm_query(variant):
    def fn(spark, sf_dir):
        h = _hurdle_inputs(spark, sf_dir)
        a, b = sex_renormalize(F.col("male_pct"), F.col("female_pct"), variant=variant)
        return h.select(*ROW_KEY, a.alias("male_pct"), b.alias("female_pct"))
    return fn


_S = "(y_male_pct + y_female_pct)"
register("sex_renorm_package", _HURDLE_BASE + f"""
SELECT row_id, copy_no, round(y_male_pct / CASE WHEN {_S} = 0 THEN 1e0 ELSE {_S} END, 6) AS male_pct,
       round(y_female_pct / CASE WHEN {_S} = 0 THEN 1e0 ELSE {_S} END, 6) AS female_pct FROM hin""")(_renorm_query("package"))
register("sex_renorm_eps", _HURDLE_BASE + f"""
SELECT row_id, copy_no, round(least(greatest(y_male_pct / ({_S} + 1e-8), 0e0), 1e0), 6) AS male_pct,
       round(least(greatest(y_female_pct / ({_S} + 1e-8), 0e0), 1e0), 6) AS female_pct FROM hin""")(_renorm_query("notebook_eps"))
register("sex_renorm_positive", _HURDLE_BASE + f"""
SELECT row_id, copy_no, round(CASE WHEN {_S} > 0 THEN y_male_pct / {_S} ELSE y_male_pct END, 6) AS male_pct,
       round(CASE WHEN {_S} > 0 THEN y_female_pct / {_S} ELSE y_female_pct END, 6) AS female_pct FROM hin""")(_renorm_query("positive_only"))


# --------------------------------------------------------------------------- attribution roll-ups

from cohortspark.operators import attribution as A  # noqa: E402

EMB_DIM = 64
ATTR_NAMES = A.default_feature_layout(EMB_DIM, NUMERIC_COLS)
TEXT_DIM = 64


def _attr_long(spark, sf_dir):
    """Long attribution-shaped table from ``embeddings``: key = vec_id,
    target = label_<label>, feature = layout name of the vector position."""
    e = read_table(spark, sf_dir, "embeddings")
    names = F.array(*[F.lit(n) for n in ATTR_NAMES])
    return (e.select(F.col("vec_id").alias("key"), F.concat(F.lit("label_"), F.col("label").cast("string")).alias("target"),
                     F.posexplode("embedding").alias("pos", "v"))
             .select("key", "target", F.element_at(names, F.col("pos") + 1).alias("feature"),
                     F.col("v").cast("double").alias("value")))


def _sql_list(xs):
    return "[" + ", ".join(O.q(x) for x in xs) + "]"


def _sql_group(f: str) -> str:
    emb = " OR ".join([f"regexp_matches({f}, '^[0-9]+$')"] + [f"starts_with({f}, {O.q(p)})" for p in A.EMBED_PREFIXES])
    design = " OR ".join(f"starts_with({f}, {O.q(r)})" for r in A.DESIGN_ROOTS)
    geo = ", ".join(O.q(c) for c in A.REQUIRED_GEO_NUMERIC_COLS)
    return (f"(CASE WHEN {emb} THEN {O.q(A.GROUP_TEXT)} WHEN starts_with({f}, 'eligibility_') OR contains({f}, 'age') "
            f"THEN {O.q(A.GROUP_ELIGIBILITY)} WHEN {f} IN ({geo}) THEN {O.q(A.GROUP_SCOPE)} "
            f"WHEN {design} THEN {O.q(A.GROUP_DESIGN)} ELSE {O.q(A.GROUP_OTHER)} END)")


def _sql_block(f: str) -> str:
    nums = ", ".join(O.q(c) for c in NUMERIC_COLS)
    return (f"(CASE WHEN {f} IN ({nums}) THEN 'numeric' WHEN starts_with({f}, 'text_emb_') "
            f"THEN 'text_embeddings' ELSE 'categorical_onehot' END)")


_ATTR_BASE = f"""WITH lng AS (SELECT vec_id AS key, 'label_' || CAST(label AS VARCHAR) AS target,
    {_sql_list(ATTR_NAMES)}[pos] AS feature, CAST(v AS DOUBLE) AS value
  FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)),
bt AS (SELECT target, feature, avg(abs(value)) AS mean_abs FROM lng GROUP BY target, feature),
gl AS (SELECT feature, avg(mean_abs) AS mean_abs_shap FROM bt GROUP BY feature)
"""


def _by_target(spark, sf_dir):
    return A.mean_abs_by_target(_attr_long(spark, sf_dir))


@register("attr_by_target", _ATTR_BASE + "SELECT target, feature, round(mean_abs, 6) AS mean_abs FROM bt")
def q_attr_by_target(spark, sf_dir):
    return _by_target(spark, sf_dir)


@register("attr_global", _ATTR_BASE + "SELECT feature, round(mean_abs_shap, 6) AS mean_abs_shap FROM gl")
def q_attr_global(spark, sf_dir):
    return A.global_importance(_by_target(spark, sf_dir))


@register("attr_group_mass", _ATTR_BASE + f"""
SELECT {_sql_block('feature')} AS "group", round(sum(mean_abs_shap), 6) AS aggregated_shap_mass,
       count(*) AS n_features, round(avg(mean_abs_shap), 6) AS mean_per_feature FROM gl GROUP BY 1""")
def q_attr_group_mass(spark, sf_dir):
    g = A.group_mass(A.global_importance(_by_target(spark, sf_dir)), A.block_group(F.col("feature"), NUMERIC_COLS))
    return g.select("group", F.col("mean_abs_shap_sum").alias("aggregated_shap_mass"), "n_features",
                    F.col("mean_abs_shap_per_feature").alias("mean_per_feature"))


@register("attr_group_median", _ATTR_BASE + f"""
SELECT {_sql_group('feature')} AS "group", round(sum(mean_abs_shap), 6) AS mean_abs_shap_sum, count(*) AS n_features,
       round(avg(mean_abs_shap), 6) AS mean_abs_shap_per_feature,
       round(median(mean_abs_shap), 6) AS median_abs_shap_per_feature FROM gl GROUP BY 1""")
def q_attr_group_median(spark, sf_dir):
    return A.group_mass(A.global_importance(_by_target(spark, sf_dir)), A.feature_group(F.col("feature")),
                        with_median=True)


@register("attr_group_no_embed", _ATTR_BASE + f"""
SELECT {_sql_group('feature')} AS "group", round(sum(mean_abs_shap), 6) AS mean_abs_shap_sum, count(*) AS n_features,
       round(avg(mean_abs_shap), 6) AS mean_abs_shap_per_feature
FROM gl WHERE NOT starts_with(feature, 'text_emb_') GROUP BY 1""")
def q_attr_group_no_embed(spark, sf_dir):
    gl = A.global_importance(_by_target(spark, sf_dir)).where(~A.is_embedding(F.col("feature")))
    return A.group_mass(gl, A.feature_group(F.col("feature")))


_SPARSE = 0.05  # smaller values are left out, as zeros are in a sparse table


@register("attr_sparse_groups", f"""WITH lng AS (SELECT vec_id AS key, 'label_' || CAST(label AS VARCHAR) AS target,
    {_sql_list(ATTR_NAMES)}[pos] AS feature, CAST(v AS DOUBLE) AS value
  FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)),
kept AS (SELECT * FROM lng WHERE abs(value) >= {_SPARSE} AND feature NOT LIKE '%7'),
bt AS (SELECT target, feature, sum(abs(value)) / (SELECT count(*) FROM embeddings) AS mean_abs FROM kept GROUP BY target, feature),
f AS (SELECT unnest({_sql_list(ATTR_NAMES)}) AS feature),
gl AS (SELECT f.feature, coalesce(sum(mean_abs), 0) / 10 AS mean_abs_shap FROM f LEFT JOIN bt ON bt.feature = f.feature GROUP BY f.feature)
SELECT {_sql_group('feature')} AS "group", round(sum(mean_abs_shap), 6) AS mean_abs_shap_sum, count(*) AS n_features,
  round(avg(mean_abs_shap), 6) AS mean_abs_shap_per_feature, round(median(mean_abs_shap), 6) AS median_abs_shap_per_feature FROM gl GROUP BY 1""")
def q_attr_sparse_groups(spark, sf_dir):
    long = _attr_long(spark, sf_dir)
    kept = long.where((F.abs("value") >= _SPARSE) & ~F.col("feature").endswith("7"))
    n = read_table(spark, sf_dir, "embeddings").count()
    features = spark.createDataFrame([(x,) for x in ATTR_NAMES], "feature string")
    glob = A.global_importance(A.mean_abs_by_target(kept, n), 10, features)
    mass = A.sorted_groups(A.group_mass(glob, A.feature_group(F.col("feature")), with_median=True))
    return mass.select("group", *[F.round(c, 6).alias(c) if c != "n_features" else F.col(c) for c in mass.columns if c != "group"])


@register("attr_group_by_target", _ATTR_BASE + f"""
SELECT {_sql_block('feature')} AS "group", target, round(sum(mean_abs), 6) AS sum_mean_abs_shap FROM bt GROUP BY 1, 2""")
def q_attr_group_by_target(spark, sf_dir):
    return A.group_by_target(_by_target(spark, sf_dir), A.block_group(F.col("feature"), NUMERIC_COLS))


@register("attr_pivot", _ATTR_BASE + f""", gt AS (SELECT target, {_sql_group('feature')} AS g, sum(mean_abs) AS s FROM bt GROUP BY 1, 2)
SELECT target, {", ".join(f"round(coalesce(sum(s) FILTER (WHERE g = {O.q(g)}), 0e0), 6) AS {chr(34) + g + chr(34)}" for g in A.GROUP_ORDER)}
FROM gt GROUP BY target""")
def q_attr_pivot(spark, sf_dir):
    return A.group_pivot(_by_target(spark, sf_dir), A.feature_group(F.col("feature")))


@register("attr_topk", _ATTR_BASE + """
SELECT target, rank, feature, round(mean_abs, 6) AS mean_abs FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY mean_abs DESC, feature) AS INTEGER) AS rank FROM bt)
WHERE rank <= 25""")
def q_attr_topk(spark, sf_dir):
    return A.top_k_per_target(_by_target(spark, sf_dir), 25)


@register("attr_top_structured", _ATTR_BASE + """
SELECT feature, round(mean_abs_shap, 6) AS mean_abs_shap FROM gl WHERE NOT starts_with(feature, 'text_emb_')
ORDER BY mean_abs_shap DESC, feature LIMIT 50""")
def q_attr_top_structured(spark, sf_dir):
    return A.top_structured(A.global_importance(_by_target(spark, sf_dir)), 50)


def _trial_feature_list(spark, sf_dir):
    """Feature names of the trial model: numeric, one-hot levels, text slots."""
    g = cleaned_trials(spark, sf_dir)
    lv = level_table(g)
    nums = spark.createDataFrame([(c,) for c in NUMERIC_COLS], "feature string")
    texts = spark.range(TEXT_DIM).select(F.format_string("text_emb_%03d", F.col("id").cast("int")).alias("feature"))
    return nums.unionByName(lv.select(F.concat_ws("_", "col", "level").alias("feature"))).unionByName(texts)


_FEATS_SQL = O.cleaned_cte() + _levels_sql() + f""", feats AS (
  SELECT unnest({_sql_list(NUMERIC_COLS)}) AS feature UNION ALL SELECT col || '_' || level FROM lvp
  UNION ALL SELECT printf('text_emb_%03d', i) FROM range({TEXT_DIM}) t(i))
"""


@register("feature_groups", _FEATS_SQL + f"SELECT feature, {_sql_group('feature')} AS \"group\" FROM feats")
def q_feature_groups(spark, sf_dir):
    return _trial_feature_list(spark, sf_dir).select("feature", A.feature_group(F.col("feature")).alias("group"))


def _sql_title(x: str) -> str:
    return (f"array_to_string(list_transform(string_split({x}, ''), lambda c, i: CASE WHEN i = 1 OR NOT "
            f"coalesce(regexp_matches(string_split({x}, '')[i - 1], '^\\p{{L}}$'), false) THEN upper(c) ELSE lower(c) END), '')")


_GEO_CASE = " ".join(f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in A.GEO_LABELS.items())


@register("feature_labels", _FEATS_SQL + f"""
SELECT feature, CASE WHEN regexp_matches(feature, '^[0-9]+$') THEN 'text_embed_' || feature
  WHEN feature IN ({", ".join(O.q(k) for k in A.GEO_LABELS)}) THEN (CASE feature {_GEO_CASE} END)
  ELSE {_sql_title("trim(replace(feature, '_', ' '), ' ')")} END AS label FROM feats""")
def q_feature_labels(spark, sf_dir):
    return _trial_feature_list(spark, sf_dir).select("feature", A.pretty_feature_name(F.col("feature")).alias("label"))


# --------------------------------------------------------------------------- text embeddings

from cohortspark.functions.numeric import l2_normalize  # noqa: E402
from cohortspark.operators.embed import hashed_long, mean_pool  # noqa: E402


def _merged(spark, sf_dir):
    c = cleaned_trials(spark, sf_dir)
    return c.select(*ROW_KEY, merge_text(TEXT_COLS, TEXT_COLS).alias("merged_text"))


def _emb_fingerprint(lng):
    return lng.groupBy(*ROW_KEY).agg(
        F.count(F.lit(1)).alias("n_nonzero"), F.sum(F.abs("value")).alias("l1"),
        F.sum(F.col("value") * F.col("value")).alias("l2sq"),
        F.sum((F.col("bucket") + 1) * F.col("value")).alias("weighted"))


@register("text_embedding", O.cleaned_cte() + f"""
, mt AS (SELECT row_id, copy_no, {O.merge_text_sql(TEXT_COLS, O.TRIALS_PRESENT_TEXT)} AS merged_text FROM trials),
tk AS (SELECT row_id, copy_no, unnest(regexp_split_to_array(translate(merged_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\p{{L}}\\p{{N}}]+')) AS tok FROM mt),
hb AS (SELECT row_id, copy_no, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % 384 AS INTEGER) AS bucket,
        CASE WHEN substr(md5(tok), 9, 1) < '8' THEN 1e0 ELSE -1e0 END AS s FROM tk WHERE tok <> ''),
lng AS (SELECT row_id, copy_no, bucket, sum(s) AS value FROM hb GROUP BY 1, 2, 3 HAVING sum(s) <> 0)
SELECT row_id, copy_no, count(value) AS n_nonzero, round(coalesce(sum(abs(value)), 0e0), 6) AS l1,
       round(coalesce(sum(value * value), 0e0), 6) AS l2sq, round(coalesce(sum((bucket + 1) * value), 0e0), 6) AS weighted
FROM mt LEFT JOIN lng USING (row_id, copy_no) GROUP BY 1, 2""")
def q_text_embedding(spark, sf_dir):
    """Hashed embedding of every trial's merged text (the dense production
    path), reported as an exact per-row fingerprint of the vector
    (non-zeros, L1, L2², bucket-weighted sum); a row without tokens has zeros."""
    from cohortspark.operators.embed import hashed_embedding
    e = hashed_embedding(_merged(spark, sf_dir), ROW_KEY, "merged_text", dim=384)
    fp = _fingerprint_udf()(F.col("embedding"))
    return e.select(*ROW_KEY, fp.alias("fp")).select(*ROW_KEY, "fp.*")


def _fingerprint_udf():
    return _vector_fingerprint


@register("l2_normalize", """
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(CAST(v AS DOUBLE) / greatest(sqrt(nrm), 1e-12), 6) AS value FROM (
  SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos,
         list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS nrm FROM embeddings)""")
def q_l2_normalize(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(l2_normalize(F.col("embedding"))).alias("pos", "value"))


@register("mean_pool", """
WITH tokv AS (SELECT vec_id // 8 AS text_id, vec_id, embedding, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS m FROM embeddings),
el AS (SELECT text_id, m, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM tokv)
SELECT text_id, CAST(pos AS INTEGER) AS pos,
       round(sum(CAST(v AS DOUBLE) * m) / greatest(sum(m) / 1e0, 1e-9), 6) AS value FROM el GROUP BY text_id, pos""")
def q_mean_pool(spark, sf_dir):
    """Vectors of 8 consecutive ids act as one text's token states (a bounded
    group, like a 256-token window); every third token is masked out."""
    e = read_table(spark, sf_dir, "embeddings")
    g = e.groupBy((F.col("vec_id") / 8).cast("long").alias("text_id")).agg(
        F.sort_array(F.collect_list(F.struct("vec_id", "embedding",
                                             F.when(F.col("vec_id") % 3 == 0, 0).otherwise(1).alias("m")))).alias("t"))
    pooled = mean_pool(F.col("t.embedding"), F.col("t.m"))
    return g.select("text_id", F.posexplode(pooled).alias("pos", "value"))


# --------------------------------------------------------------------------- fitted models (rows-only checks)

from cohortspark.plans import train as TJ  # noqa: E402
from cohortspark.operators.models import CHECK_PRESET, CHECK_TUNED  # noqa: E402
from cohortspark.operators.scoring import PRED_PREFIX  # noqa: E402

MODEL_TEXT_DIM = 64


def _train(spark, sf_dir, out_dir=None, **kw):
    raw = trials_view(spark, sf_dir)
    # small models, so that the checks end; the library's defaults are the reference's sizes
    return TJ.train_pipeline(spark, raw, target_cols=TARGET_COLS, text_dim=MODEL_TEXT_DIM, **{"params": CHECK_PRESET, **kw},
                            hurdle_params=CHECK_PRESET, index_cols=("sponsor",), row_key=ROW_KEY, out_dir=out_dir)


_PRED_COLS = [PRED_PREFIX + t for t in TARGET_COLS]


@register("gbt_multi_target")
def q_gbt_multi_target(spark, sf_dir):
    out = _train(spark, sf_dir, sparse_targets=())
    from cohortspark.operators.models import predict_multitarget
    p = predict_multitarget(out.split_frame, out.artifacts.models, pred_prefix=PRED_PREFIX)
    return p.select(*ROW_KEY, "split", *_PRED_COLS)


@register("gbt_hurdle")
def q_gbt_hurdle(spark, sf_dir):
    out = _train(spark, sf_dir)
    df = out.split_frame
    for t, h in out.artifacts.hurdles.items():
        df = h.transform(df, prefix=f"{t}__")
    cols = [f"{t}__{x}" for t in out.artifacts.hurdles for x in ("y_pred", "p_present", "y_cond", "present")]
    return df.select(*ROW_KEY, "split", *cols)


@register("scored_frozen")
def q_scored_frozen(spark, sf_dir):
    art_dir = TJ.scratch_dir(spark, "artifacts")
    _train(spark, sf_dir, out_dir=art_dir)
    scored = TJ.score_with_artifacts(spark, trials_view(spark, sf_dir), art_dir)
    return scored.select(*ROW_KEY, "nct_id", *_PRED_COLS)


@register("scored_frozen_same", O.cleaned_cte() + "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_differ FROM geo")
def q_scored_frozen_same(spark, sf_dir):
    """Rows scored with reloaded artifacts that differ from scores of the models in memory: there are none."""
    from cohortspark.operators.scoring import score_frame
    art_dir = TJ.scratch_dir(spark, "artifacts")
    out = _train(spark, sf_dir, out_dir=art_dir)
    frozen = TJ.score_with_artifacts(spark, trials_view(spark, sf_dir), art_dir)
    live = score_frame(out.split_frame, out.artifacts)
    pairs = (frozen.select(*ROW_KEY, F.array(*_PRED_COLS).alias("frozen"))
             .join(live.select(*ROW_KEY, F.array(*_PRED_COLS).alias("live")), ROW_KEY, "full"))
    near = F.forall(F.zip_with("frozen", "live", lambda a, b: F.coalesce(F.abs(a - b) <= 1e-9, F.lit(False))), lambda ok: ok)
    return pairs.agg(F.count("frozen").alias("n_rows"), F.count_if(~F.coalesce(near, F.lit(False))).alias("n_differ"))


@register("evaluate_table")
def q_evaluate_table(spark, sf_dir):
    out = _train(spark, sf_dir)
    from cohortspark.operators.scoring import score_frame
    return TJ.evaluate(score_frame(out.split_frame, out.artifacts), TARGET_COLS)


@register("baselines_report")
def q_baselines_report(spark, sf_dir):
    out = _train(spark, sf_dir)
    return TJ.run_baselines(spark, out, TARGET_COLS, params=CHECK_PRESET)


# --------------------------------------------------------------------------- stream scoring

@register("stream_scored")
def q_stream_scored(spark, sf_dir):
    """Raw trial rows replayed as a file stream, scored per micro-batch with
    frozen artifacts (medians, encoder, models, OOD stats)."""
    from cohortspark.sources.trials_view import trials_path
    from cohortspark.streaming.score_stream import read_parquet_stream, start_stream_scoring
    art_dir = TJ.scratch_dir(spark, "artifacts")
    raw = trials_view(spark, sf_dir)
    _train(spark, sf_dir, out_dir=art_dir)
    src_path = trials_path(spark, sf_dir)
    out_dir = TJ.scratch_dir(spark, "stream-out")
    q = start_stream_scoring(spark, read_parquet_stream(spark, src_path, raw.schema), art_dir, out_dir,
                             select_cols=[*ROW_KEY, "nct_id", *_PRED_COLS, "ood_score", "ood_warn", "ood_crit"])
    q.awaitTermination()
    return spark.read.parquet(out_dir).drop("batch_id")


# --------------------------------------------------------------------------- tree attributions

ATTR_SAMPLE = 2000


def _explained(spark, sf_dir):
    """Training result, the sample that is explained (reference size), its attributions and base values."""
    from cohortspark.operators.treeshap import tree_attributions
    out = _train(spark, sf_dir)
    sample = sample_n(out.split_frame, ATTR_SAMPLE, key_cols=ROW_KEY)
    sample = sample.withColumn("key", F.concat_ws(":", *[F.col(c).cast("string") for c in ROW_KEY]))
    long, base = tree_attributions(sample, out.artifacts.models, key_col="key")
    return out, sample, long, base


def _attributions(spark, sf_dir):
    from cohortspark.operators.features import feature_names
    from cohortspark.operators.treeshap import name_features
    out, sample, long, _ = _explained(spark, sf_dir)
    m = out.artifacts.manifest
    names = feature_names(m["num_cols"], m["cat_feature_names"], m["embedding_dim"])
    scale = {"n_rows": sample.count(), "n_targets": len(out.artifacts.models), "features": spark.createDataFrame([(n,) for n in names], "feature string")}
    return name_features(long, names), scale


@register("tree_attributions")
def q_tree_attributions(spark, sf_dir):
    long, _ = _attributions(spark, sf_dir)
    return long.select("key", "target", "feature", "value")


@register("attributions_add_up", O.cleaned_cte() +
          f"SELECT least({ATTR_SAMPLE}, count(*)) * {len(TARGET_COLS)} AS n_pairs, CAST(0 AS BIGINT) AS n_off FROM geo")
def q_attributions_add_up(spark, sf_dir):
    """Pairs of row and target where base value plus attributions miss the prediction: there are none."""
    from cohortspark.operators.models import predict_multitarget
    out, sample, long, base = _explained(spark, sf_dir)
    pred = predict_multitarget(sample, out.artifacts.models, pred_prefix=PRED_PREFIX)
    cells = [F.struct(F.lit(t).alias("target"), F.lit(b).alias("base"), F.col(PRED_PREFIX + t).alias("pred")) for t, b in base.items()]
    pairs = pred.select("key", F.explode(F.array(*cells)).alias("c")).select("key", "c.*")
    sums = long.groupBy("key", "target").agg(F.sum("value").alias("explained"))
    off = F.abs(F.col("base") + F.coalesce("explained", F.lit(0.0)) - F.col("pred"))
    return pairs.join(sums, ["key", "target"], "left").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(~(off <= 1e-6)).alias("n_off"))


@register("attribution_report")
def q_attribution_report(spark, sf_dir):
    """Group table (sum, count, mean, median of mean |attribution|) of the real attributions."""
    long, scale = _attributions(spark, sf_dir)
    glob = A.global_importance(A.mean_abs_by_target(long, scale["n_rows"]), scale["n_targets"], scale["features"])
    return A.group_mass(glob, A.feature_group(F.col("feature")), with_median=True)


# --------------------------------------------------------------------------- tuning

# The reference's ranges, with fewer trees and levels: a level of a tree is a pass over the rows.
CHECK_SEARCH_SPACE = {"iterations": (3, 10), "depth": (2, 4), "learning_rate": (0.01, 0.2),
                      "l2_leaf_reg": (1.0, 10.0)}


def _search(spark, sf_dir):
    from cohortspark.operators.tuning import tpe_search
    s = extract_targets(split_trials(spark, sf_dir), TARGET_COLS)
    feats = _structured_features(s)
    return tpe_search(feats.where("split = 'train'"), feats.where("split = 'test'"), "white_pct", key_cols=ROW_KEY, space=CHECK_SEARCH_SPACE)


def _structured_features(s):
    """Numeric and one-hot features of split rows, written once."""
    from cohortspark.operators.features import assemble_features, encode_categoricals, numeric_block
    enc = fit_categorical_encoder(s, index_cols=("sponsor",))
    f = assemble_features(encode_categoricals(numeric_block(s, NUMERIC_COLS), enc))
    return f.select(*ROW_KEY, "split", "features", *TARGET_COLS).checkpoint()


@register("random_search")
def q_random_search(spark, sf_dir):
    """25 trials of the Parzen search, best first."""
    return _search(spark, sf_dir)[0]


@register("search_checked", f"""SELECT 25 AS n_trials, CAST(0 AS BIGINT) AS n_errors_off, true AS best_is_least, 4 AS n_dimensions_used, CAST(0 AS BIGINT) AS n_outside""")
def q_search_checked(spark, sf_dir):
    """The search's own errors against the RMSE of its stored predictions; every dimension varies within its range."""
    trials, predictions, _ = _search(spark, sf_dir)
    again = predictions.groupBy("trial").agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2)).alias("again"))
    first = trials.first()["trial"]
    inside = [F.col(k).between(lo, hi) for k, (lo, hi) in CHECK_SEARCH_SPACE.items()]
    both = trials.join(again, "trial")
    return both.agg(F.count(F.lit(1)).cast("int").alias("n_trials"), F.count_if(F.abs(F.col("rmse") - F.col("again")) > 1e-9).alias("n_errors_off"),
                    (F.min_by("trial", F.struct("again", "trial")) == first).alias("best_is_least"),
                    sum(((F.count_distinct(k) > 1).cast("int") for k in CHECK_SEARCH_SPACE), F.lit(0)).alias("n_dimensions_used"),
                    F.count_if(~(inside[0] & inside[1] & inside[2] & inside[3])).alias("n_outside"))


# --------------------------------------------------------------------------- sources and sinks

from cohortspark.sources.readers import load_dataframe  # noqa: E402
from cohortspark.sources.writers import save_dataframe  # noqa: E402

_IO_COLS = ["row_id", "copy_no", "nct_id", "eligibility_min_age", "eligibility_max_age", "sponsor",
            "Locations", "white_pct"]
_IO_ORACLE = O.cleaned_cte() + f"SELECT {', '.join(_IO_COLS[:-1])}, round(white_pct, 6) AS white_pct FROM trials"


def _round_trip(spark, sf_dir, suffix, schema=None):
    t = trials_view(spark, sf_dir).select(*_IO_COLS)
    path = TJ.scratch_dir(spark, "io") + suffix
    save_dataframe(t, path)
    return load_dataframe(spark, path, schema=schema or (t.schema if suffix == ".csv" else None))


@register("feather_round_trip", _IO_ORACLE)
def q_feather_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, ".feather")


# CSV has one spelling for empty and missing text: both read back as null.
_CSV_ORACLE = O.cleaned_cte() + "SELECT row_id, copy_no, " + ", ".join(
    f"nullif({c}, '') AS {c}" for c in _IO_COLS[2:-1]) + ", round(white_pct, 6) AS white_pct FROM trials"


@register("csv_round_trip", _CSV_ORACLE)
def q_csv_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, ".csv")


@register("parquet_round_trip", _IO_ORACLE)
def q_parquet_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, ".parquet")


# --------------------------------------------------------------------------- split checks, counts, exports

from cohortspark.operators.split import check_disjoint, stable_split  # noqa: E402


@register("split_disjoint", O.cleaned_cte() + O.split_cte() + """
SELECT coalesce(nct_id, '__null__') AS key, count(DISTINCT split) AS n_splits FROM splitted GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def q_split_disjoint(spark, sf_dir):
    return check_disjoint(split_trials(spark, sf_dir))


@register("split_stable", O.cleaned_cte() + """
, u AS (SELECT row_id, copy_no, CAST(('0x' || substr(md5('42:' || coalesce(nct_id, '__null__')), 1, 8))::BIGINT AS DOUBLE) / 4294967296e0 AS u FROM geo)
SELECT row_id, copy_no, CASE WHEN u < 0.64e0 THEN 'train' WHEN u < 0.64e0 + 0.16e0 THEN 'test' ELSE 'holdout' END AS split FROM u""")
def q_split_stable(spark, sf_dir):
    return stable_split(cleaned_trials(spark, sf_dir)).select(*ROW_KEY, "split")


@register("feature_group_counts", _FEATS_SQL + f"SELECT {_sql_group('feature')} AS \"group\", count(*) AS n FROM feats GROUP BY 1")
def q_feature_group_counts(spark, sf_dir):
    f = _trial_feature_list(spark, sf_dir)
    return f.groupBy(A.feature_group(F.col("feature")).alias("group")).agg(F.count(F.lit(1)).alias("n"))


@register("attr_ranked_json", _ATTR_BASE + """
SELECT target, rank, feature, round(mean_abs, 6) AS mean_abs_shap FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY mean_abs DESC, feature) AS INTEGER) AS rank FROM bt)
WHERE rank <= 25""")
def q_attr_ranked_json(spark, sf_dir):
    """IO13: per-target top-25 lists written as JSON to the shared folder, read back and unfolded in their order."""
    path = TJ.scratch_dir(spark, "ranked-json")
    A.write_ranked_json(_by_target(spark, sf_dir), path, 25)
    rows = spark.read.json(path).select("target", F.posexplode("features").alias("at", "f"))
    return rows.select("target", (F.col("at") + 1).alias("rank"), "f.feature", "f.mean_abs_shap")


@register("display_percent", _BASE + _pred_cte("pm", []) + f"""
SELECT row_id, copy_no, {", ".join(f"round(p_{t} * 100e0, 2) AS {t}" for t in TARGET_COLS)} FROM pm""")
def q_display_percent(spark, sf_dir):
    from cohortspark.functions.numeric import as_percent
    p = _mean_predictions(spark, sf_dir)
    return p.select(*ROW_KEY, *[as_percent(F.col(f"pred_{t}")).alias(t) for t in TARGET_COLS])


@register("parse_age_notebook", O.cleaned_cte() + f"""
SELECT row_id, copy_no, round({O.parse_age_notebook_sql('eligibility_min_age')}, 6) AS min_age_years,
       round({O.parse_age_notebook_sql('eligibility_max_age')}, 6) AS max_age_years FROM trials""")
def q_parse_age_notebook(spark, sf_dir):
    """the notebook's age rule (its own token list, no sign stripping)."""
    t = clean_ops.with_parsed(trials_view(spark, sf_dir), variant="notebook")
    return t.select(*ROW_KEY, F.col("_pmin").alias("min_age_years"), F.col("_pmax").alias("max_age_years"))


def _nb_clean_sql() -> str:
    cats = ", ".join(f"(CASE WHEN {c} IS NULL OR {c} IN ('nan', 'None', 'Unknown') THEN 'Unknown' ELSE {c} END) AS {c}"
                     for c in CAT_COLS)
    return O.cleaned_cte() + f""", nbp AS (SELECT *, {O.parse_age_notebook_sql('eligibility_min_age')} AS qmin,
    {O.parse_age_notebook_sql('eligibility_max_age')} AS qmax FROM trials),
nbm AS (SELECT coalesce(median(qmin), 0e0) AS mmin, coalesce(median(qmax), 100e0) AS mmax FROM nbp)
SELECT row_id, copy_no, round(coalesce(qmin, mmin), 6) AS eligibility_min_age_yrs,
       round(coalesce(qmax, mmax), 6) AS eligibility_max_age_yrs,
       CAST(qmin IS NULL AS INTEGER) AS min_age_missing, CAST(qmax IS NULL AS INTEGER) AS max_age_missing, {cats}
FROM nbp, nbm"""


@register("clean_notebook", _nb_clean_sql())
def q_clean_notebook(spark, sf_dir):
    """Notebook cleaning: its age rule, no clamp or swap, '' kept as a category."""
    t = trials_view(spark, sf_dir)
    stats = clean_ops.fit_clean(t, variant="notebook")
    c = clean_ops.apply_clean(t, stats, clamp=False, swap=False, variant="notebook")
    return c.select(*ROW_KEY, "eligibility_min_age_yrs", "eligibility_max_age_yrs", "min_age_missing",
                    "max_age_missing", *CAT_COLS)


@register("attr_pivot_mean", _ATTR_BASE + f""", gt AS (SELECT target, {_sql_group('feature')} AS g, avg(mean_abs) AS s FROM bt GROUP BY 1, 2)
SELECT target, {", ".join(f"round(coalesce(sum(s) FILTER (WHERE g = {O.q(g)}), 0e0), 6) AS {chr(34) + g + chr(34)}" for g in A.GROUP_ORDER)}
FROM gt GROUP BY target""")
def q_attr_pivot_mean(spark, sf_dir):
    """A16 (per-feature mean variant): target × group mean of mean |value|, missing → 0."""
    return A.group_pivot(_by_target(spark, sf_dir), A.feature_group(F.col("feature")), how="mean")


@register("gbt_early_stopping")
def q_gbt_early_stopping(spark, sf_dir):
    """The tuned fit, which stops on the test rows' error and keeps the trees up to its best round."""
    out = _train(spark, sf_dir, sparse_targets=(), params=CHECK_TUNED)
    from cohortspark.operators.models import predict_multitarget
    p = predict_multitarget(out.split_frame, out.artifacts.models, pred_prefix=PRED_PREFIX)
    return p.select(*ROW_KEY, "split", *_PRED_COLS)


# --------------------------------------------------------------------------- trees with vector leaves

from cohortspark.operators import multiboost as MB  # noqa: E402
from cohortspark.operators.features import assemble_features, numeric_block  # noqa: E402
from cohortspark.plans.boost_sql import boost_ctes, staged_sql  # noqa: E402

VECTOR_TREE = {"iterations": 1, "depth": 3, "learning_rate": 1.0, "l2_leaf_reg": 3.0}
VECTOR_STAGES = {"iterations": 4, "depth": 2, "learning_rate": 0.5, "l2_leaf_reg": 5.0}


def _boost_sql(p: dict) -> str:
    return boost_ctes(rounds=p["iterations"], depth=p["depth"], rate=p["learning_rate"], l2=p["l2_leaf_reg"])


def _numeric_features(spark, sf_dir):
    s = extract_targets(split_trials(spark, sf_dir), TARGET_COLS)
    f = assemble_features(numeric_block(s, NUMERIC_COLS), with_cat=False)
    return f.select(*ROW_KEY, "split", "features", *TARGET_COLS).checkpoint()


@register("vector_tree", _BASE + _boost_sql(VECTOR_TREE) + f"""
SELECT row_id, copy_no, split, {", ".join(f"round(p_{i}, 6) AS pred_{t}" for i, t in enumerate(TARGET_COLS))} FROM e1""")
def q_vector_tree(spark, sf_dir):
    """M7: one tree for all targets; its leaves are group means of the targets shrunk by the L2 term."""
    f = _numeric_features(spark, sf_dir)
    model = MB.fit_members(f.where("split = 'train'"), [MB.member_of("main", TARGET_COLS, VECTOR_TREE)], key_cols=ROW_KEY)["main"]
    return model.predict(f, _PRED_COLS).select(*ROW_KEY, "split", *_PRED_COLS)


@register("vector_stages", _BASE + _boost_sql(VECTOR_STAGES) + staged_sql(VECTOR_STAGES["iterations"]))
def q_vector_stages(spark, sf_dir):
    """M8: the error of every prefix of an ensemble in one scoring pass, and its best round."""
    f = _numeric_features(spark, sf_dir)
    model = MB.fit_members(f.where("split <> 'holdout'").withColumn("_v", F.col("split") == "test"), [MB.member_of("main", TARGET_COLS, VECTOR_STAGES)],
                           valid_col="_v", key_cols=ROW_KEY)["main"]
    return MB.staged_errors(f, model, by=["split"]).withColumn("is_best", F.col("round") == model.best_round)


# --------------------------------------------------------------------------- text encoder slot

_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _letter_counter(files):
    """A toy encoder with weights from a shipped file: letter counts times the letter's weight."""
    import json

    class Counts:
        def __init__(self):
            with open(files["letter_weights.json"]) as f:
                self.weights = np.array(json.load(f))

        def encode(self, texts, max_length):
            return np.array([[t.count(c) for c in _LETTERS] for t in texts], float) * self.weights
    return Counts()


def _letter_encoder():
    import json
    import tempfile

    from cohortspark.operators.embed import TextEncoder
    path = f"{tempfile.mkdtemp(prefix='cs-encoder-')}/letter_weights.json"  # on the driver; Spark ships it
    with open(path, "w") as f:
        json.dump([i + 1 for i in range(26)], f)
    return TextEncoder("letter-counts", 26, _letter_counter, files=(path,), max_length=None)


@register("encoder_slot", O.cleaned_cte() + f"""
, mt AS (SELECT row_id, copy_no, {O.merge_text_sql(TEXT_COLS, O.TRIALS_PRESENT_TEXT)} AS t FROM trials)
SELECT row_id, copy_no, {", ".join(f"CAST((length(t) - length(replace(t, '{c}', ''))) * {i + 1} AS DOUBLE) AS n_{c}" for i, c in enumerate(_LETTERS) if c in "aeiouz")},
  CAST({" + ".join(f"(length(t) - length(replace(t, '{c}', ''))) * {i + 1}" for i, c in enumerate(_LETTERS))} AS DOUBLE) AS total FROM mt""")
def q_encoder_slot(spark, sf_dir):
    """Vectors of a plugged-in encoder, through the registry that training, scoring and streams use."""
    from cohortspark.operators.embed import register_encoder, text_embedding
    enc = register_encoder(_letter_encoder())
    e = text_embedding(_merged(spark, sf_dir), "merged_text", enc.encoder_id, dim=enc.dim)
    v = F.col("embedding")
    return e.select(*ROW_KEY, *[v[i].cast("double").alias(f"n_{c}") for i, c in enumerate(_LETTERS) if c in "aeiouz"],
                    F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"))


# --------------------------------------------------------------------------- joined blocks, audits, jobs from file to file

@register("joined_blocks", """
SELECT vec_id, label, len(embedding) AS n_dims, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total,
  round(list_sum(list_transform(embedding, lambda x, i: i * CAST(x AS DOUBLE))), 6) AS weighted FROM embeddings""")
def q_joined_blocks(spark, sf_dir):
    """Stored vectors, kept as two blocks, and the structured block joined 1:1 by key."""
    from cohortspark.operators.joins import join_blocks
    e = read_table(spark, sf_dir, "embeddings")
    low, high = F.slice("embedding", 1, 32), F.slice("embedding", 33, F.greatest(F.size("embedding") - 32, F.lit(0)))
    j = join_blocks({"structured": e.select("vec_id", "label"), "low": e.select("vec_id", low.alias("low_vec")), "high": e.select("vec_id", high.alias("high_vec"))}, ["vec_id"])
    v = F.transform(F.concat("low_vec", "high_vec"), lambda x: x.cast("double"))
    add = lambda a, x: a + x
    return j.select("vec_id", "label", F.size(v).cast("long").alias("n_dims"), F.aggregate(v, F.lit(0.0), add).alias("total"),
                    F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), add).alias("weighted"))


_OUTSIDE = "row_id % 7 <> 3"  # the outside file lacks the other rows, and has some that the truth lacks


@register("audited_evaluation", _BASE + _pred_cte("pm", []) + f", ps AS (SELECT * FROM pm WHERE {_OUTSIDE}), lm AS ({_long_sql('ps')})" + f"""
SELECT split, target, round(rmse, 6) AS rmse, round(mae, 6) AS mae, n, (SELECT count(*) FROM pm WHERE NOT ({_OUTSIDE})) AS truth_only,
  (SELECT count(*) FROM pm WHERE row_id % 11 = 5) AS pred_only, (SELECT count(*) FROM ps) AS matched FROM lm""")
def q_audited_evaluation(spark, sf_dir):
    """Errors of predictions from elsewhere, with the keys that either side lacks."""
    from cohortspark.operators.joins import audit_predictions
    p = _mean_predictions(spark, sf_dir)
    outside = p.select(*ROW_KEY, *_pred_cols())
    extra = outside.where("row_id % 11 = 5").withColumn("copy_no", F.col("copy_no") + 10)
    long, audit = audit_predictions(p.select(*ROW_KEY, "split", *TARGET_COLS), outside.where(_OUTSIDE).unionByName(extra), ROW_KEY, TARGET_COLS, _pred_cols())
    return long.withColumns({k: F.lit(audit[k]).cast("long") for k in ("truth_only", "pred_only", "matched")})


@register("mahalanobis_check", O.cleaned_cte() + O.split_cte() + _mahalanobis_sql() + """,
th AS (SELECT quantile_cont(d, 0.99) AS t FROM ds WHERE split = 'train')
SELECT row_id, copy_no, split, d > t + 1e-9 AS is_ood, round(t, 6) AS threshold FROM ds, th""")
def q_mahalanobis_check(spark, sf_dir):
    """Rows beyond the exact 99th percentile of the train distances."""
    from cohortspark.operators.ood import check_mahalanobis, fit_mahalanobis_threshold
    s = split_trials(spark, sf_dir)
    train = s.where(F.col("split") == "train")
    model = fit_mahalanobis_threshold(train, fit_mahalanobis(train, OOD_COLS))
    flagged = check_mahalanobis(s, {**model, "threshold": model["threshold"] + 1e-9})  # rows at the threshold itself differ by rounding only
    return flagged.select(*ROW_KEY, "split", "is_ood").withColumn("threshold", F.lit(model["threshold"]))


@register("ood_file_job", O.cleaned_cte() + O.split_cte() +
          _ood_scores_sql(_ood_stats_sql("splitted", "WHERE split = 'train'", "stddev_pop", PKG_FIX)) +
          """SELECT nct_id, round(ood_score, 6) AS ood_score, ood_score >= 2e0 AS ood_warn, ood_score >= 3e0 AS ood_crit FROM sc""")
def q_ood_file_job(spark, sf_dir):
    """O4/IO10: the screening job from file to file; the rows read back."""
    from cohortspark.plans.file_jobs import ood_file
    in_path, out_path = TJ.scratch_dir(spark, "trials-in") + ".parquet", TJ.scratch_dir(spark, "ood-out") + ".parquet"
    write_trials(trials_view(spark, sf_dir), in_path)
    ood_file(spark, in_path, out_path)
    return load_dataframe(spark, out_path)


@register("scored_file_same", O.cleaned_cte() + "SELECT count(*) AS n_rows, count(DISTINCT nct_id) AS n_keys, CAST(0 AS BIGINT) AS n_differ FROM geo")
def q_scored_file_same(spark, sf_dir):
    """M25/IO9: raw trials to a prediction file; the sums by key read back against the models in memory."""
    from cohortspark.operators.scoring import score_frame
    from cohortspark.plans.file_jobs import score_file
    art_dir, in_path, out_path = (TJ.scratch_dir(spark, x) + y for x, y in (("artifacts", ""), ("trials-in", ".parquet"), ("scored-out", ".parquet")))
    out = _train(spark, sf_dir, out_dir=art_dir, sparse_targets=(), params={"iterations": 3, "depth": 3, "learning_rate": 0.3})
    write_trials(trials_view(spark, sf_dir), in_path)
    score_file(spark, in_path, art_dir, out_path)
    names = [f"{t}_pred" for t in TARGET_COLS]
    back = load_dataframe(spark, out_path).groupBy("nct_id").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in names]).alias("file"))
    live = score_frame(out.split_frame, out.artifacts).groupBy("nct_id").agg(F.array(*[F.sum(c) for c in _PRED_COLS]).alias("live"))
    both = back.join(live.withColumnRenamed("nct_id", "k"), F.col("nct_id").eqNullSafe(F.col("k")), "full")
    near = F.forall(F.zip_with("file", "live", lambda a, b: F.coalesce(F.abs(a - b) <= 1e-6, F.lit(False))), lambda ok: ok)
    return both.agg(F.sum("n").alias("n_rows"), F.count_distinct("nct_id").alias("n_keys"), F.count_if(~F.coalesce(near, F.lit(False))).alias("n_differ"))


@register("attribution_job", _ATTR_BASE.replace("gl AS (", "gx AS (") + f""", n AS (SELECT count(*) AS n FROM embeddings),
fe AS (SELECT unnest({_sql_list(ATTR_NAMES)}) AS feature),
bs AS (SELECT target, feature, sum(abs(value)) / (SELECT n FROM n) AS mean_abs FROM lng WHERE abs(value) >= {_SPARSE} AND feature NOT LIKE '%7' GROUP BY 1, 2),
gl AS (SELECT fe.feature, coalesce(sum(mean_abs), 0) / 10 AS v FROM fe LEFT JOIN bs USING (feature) GROUP BY 1),
gm AS (SELECT {_sql_group('feature')} AS g, sum(v) AS v FROM gl GROUP BY 1),
ce AS (SELECT g, target, coalesce(s, 0e0) AS v FROM (SELECT DISTINCT {_sql_group('feature')} AS g FROM fe) CROSS JOIN (SELECT 'label_' || i AS target FROM range(10) r(i))
  LEFT JOIN (SELECT {_sql_group('feature')} AS g, target, sum(mean_abs) AS s FROM bs GROUP BY 1, 2) USING (g, target))
SELECT 'mean_abs_per_feature' AS table_name, row_number() OVER (ORDER BY round(v, 9) DESC, feature) AS rank, feature AS name, '' AS target, round(v, 6) AS value FROM gl
UNION ALL SELECT 'group_mass', row_number() OVER (ORDER BY round(v, 9) DESC, g), g, '', round(v, 6) FROM gm
UNION ALL SELECT * FROM (SELECT 'top_structured_features', row_number() OVER (ORDER BY round(v, 9) DESC, feature) AS r, feature, '', round(v, 6) FROM gl WHERE NOT starts_with(feature, 'text_emb_')) WHERE r <= 50
UNION ALL SELECT 'group_by_target', row_number() OVER (ORDER BY g, target), g, target, round(v, 6) FROM ce""")
def q_attribution_job(spark, sf_dir):
    """X7/IO14/L1: the job's four tables, read back through the manifest, with their order."""
    from cohortspark.plans.attribution_job import run_attribution_job
    from cohortspark.sources.writers import read_published
    long = _attr_long(spark, sf_dir)
    kept = long.where((F.abs("value") >= _SPARSE) & ~F.col("feature").endswith("7"))
    features = spark.createDataFrame([(x,) for x in ATTR_NAMES], "feature string")
    out = TJ.scratch_dir(spark, "attribution-job")
    run_attribution_job(kept, features, [f"label_{i}" for i in range(10)], read_table(spark, sf_dir, "embeddings").count(), A.feature_group(F.col("feature")), out)
    t = read_published(spark, out)
    names = {"mean_abs_per_feature": ("feature", None, "mean_abs_shap"), "group_mass": ("group", None, "aggregated_shap_mass"),
             "top_structured_features": ("feature", None, "mean_abs_shap"), "group_by_target": ("group", "target", "sum_mean_abs_shap")}
    parts = [t[n].select(F.lit(n).alias("table_name"), "rank", F.col(a).alias("name"), (F.col(b) if b else F.lit("")).alias("target"), F.col(v).alias("value")) for n, (a, b, v) in names.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register("hurdle_branches", O.cleaned_cte() + """, b(branch) AS (VALUES ('probability'), ('raw'), ('label'))
SELECT branch, (SELECT count(*) FROM geo) AS n_rows, CAST(0 AS BIGINT) AS n_outside, CAST(0 AS BIGINT) AS n_soft_off, CAST(0 AS BIGINT) AS n_hard_off FROM b""")
def q_hurdle_branches(spark, sf_dir):
    """Presence from a probability, a raw score or a label, by what the fitted model offers."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.regression import LinearRegression
    from cohortspark.operators.hurdle import HurdleModel
    f = _numeric_features(spark, sf_dir).withColumn("_here", (F.col("aian_pct") > 0).cast("double"))
    train = f.where("split = 'train'")
    amount = LinearRegression(labelCol="aian_pct", maxIter=5).fit(train.where("_here = 1"))
    presence = {"probability": LogisticRegression(labelCol="_here", maxIter=5), "raw": LinearSVC(labelCol="_here", maxIter=5), "label": LinearRegression(labelCol="_here", maxIter=5)}
    out = None
    for branch, est in presence.items():
        model = HurdleModel("aian_pct", est.fit(train), amount)
        soft, hard = model.transform(f, prefix="s_"), model.transform(f, prefix="h_", hard_gate=True)
        p, c = F.col("s_p_present"), F.col("s_y_cond")
        inside = (p.between(0, 1) & c.between(0, 1)) if branch != "label" else (p.isin(0.0, 1.0) & c.between(0, 1))
        a = soft.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~inside).alias("n_outside"), F.count_if(~(F.abs(F.col("s_y_pred") - p * c) <= 1e-12)).alias("n_soft_off"))
        b = hard.agg(F.count_if(F.col("h_y_pred") != F.when(F.col("h_p_present") >= 0.5, F.col("h_y_cond")).otherwise(0.0)).alias("n_hard_off"))
        one = a.crossJoin(b).withColumn("branch", F.lit(branch))  # one row each
        out = one if out is None else out.unionByName(one)
    return out.select("branch", "n_rows", "n_outside", "n_soft_off", "n_hard_off")


@register("evaluation_file_job", _BASE + _pred_cte("pm", []) + f", lm AS ({_long_sql('pm')})\n" + _wide_sql("lm"))
def q_evaluation_file_job(spark, sf_dir):
    """M21/IO8: truth and prediction files in, the table of errors out, read back."""
    from cohortspark.plans.file_jobs import evaluate_files
    truth, pred, out = (TJ.scratch_dir(spark, x) for x in ("truth.parquet", "pred.parquet", "errors"))
    truth, pred = truth + ".parquet", pred + ".parquet"
    write_trials(trials_view(spark, sf_dir), truth)
    p = _mean_predictions(spark, sf_dir)
    p.select(*ROW_KEY, *[F.col(f"pred_{t}").alias(f"{t}_pred") for t in TARGET_COLS]).write.parquet(pred)
    _, audit = evaluate_files(spark, truth, pred, out, key_cols=ROW_KEY, strict=True)
    return spark.read.option("header", True).option("inferSchema", True).csv(out)


TUNED_CHECK = {"iterations": 40, "depth": 4, "learning_rate": 0.3, "l2_leaf_reg": 5.0, "early_stopping_rounds": 5}


@register("tuned_checked", "SELECT true AS best_is_least, true AS kept_up_to_best, true AS stopped_in_time, CAST(0 AS BIGINT) AS n_errors_off")
def q_tuned_checked(spark, sf_dir):
    """The tuned fit stops by rounds; its staged errors against those of its trees, rescored row by row."""
    f = _numeric_features(spark, sf_dir)
    member = MB.member_of("main", TARGET_COLS, TUNED_CHECK)
    model = MB.fit_members(f.where("split <> 'holdout'").withColumn("_v", F.col("split") == "test"), [member], valid_col="_v", key_cols=ROW_KEY)["main"]
    again = MB.staged_errors(f.where("split = 'test'"), model)
    kept = spark.createDataFrame(list(enumerate(model.staged[:len(model.trees) + 1])), "round int, kept double")
    both = again.join(F.broadcast(kept), "round", "full")  # one row per tree
    least = min(model.staged)
    waited = len(model.staged) - 1 - model.best_round
    return both.agg(
        (F.min("rmse") <= least + 1e-9).alias("best_is_least"), F.lit(len(model.trees) == model.best_round).alias("kept_up_to_best"),
        F.lit(len(model.staged) - 1 == TUNED_CHECK["iterations"] or TUNED_CHECK["early_stopping_rounds"] <= waited < TUNED_CHECK["early_stopping_rounds"] + MB.REFRESH).alias("stopped_in_time"),
        F.count_if(~F.coalesce(F.abs(F.col("rmse") - F.col("kept")) <= 1e-9, F.lit(False))).alias("n_errors_off"))


@register("stream_equals_batch", O.cleaned_cte() + "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_differ FROM geo")
def q_stream_equals_batch(spark, sf_dir):
    """Rows scored by the stream that differ from the batch's scores: there are none."""
    from cohortspark.sources.trials_view import trials_path
    from cohortspark.streaming.score_stream import read_parquet_stream, start_stream_scoring
    art_dir, out_dir = TJ.scratch_dir(spark, "artifacts"), TJ.scratch_dir(spark, "stream-out")
    raw = trials_view(spark, sf_dir)
    _train(spark, sf_dir, out_dir=art_dir, sparse_targets=(), params={"iterations": 3, "depth": 3, "learning_rate": 0.3})
    start_stream_scoring(spark, read_parquet_stream(spark, trials_path(spark, sf_dir), raw.schema), art_dir, out_dir, select_cols=[*ROW_KEY, *_PRED_COLS]).awaitTermination()
    stream = spark.read.parquet(out_dir).select(*ROW_KEY, F.array(*_PRED_COLS).alias("a"))
    batch = TJ.score_with_artifacts(spark, raw, art_dir).select(*ROW_KEY, F.array(*_PRED_COLS).alias("b"))
    near = F.forall(F.zip_with("a", "b", lambda x, y: F.coalesce(F.abs(x - y) <= 1e-9, F.lit(False))), lambda ok: ok)
    return stream.join(batch, ROW_KEY, "full").agg(F.count("a").alias("n_rows"), F.count_if(~F.coalesce(near, F.lit(False))).alias("n_differ"))


@register("geo_guards", O.cleaned_cte() + """SELECT max(n_sites) AS max_sites, max(n_us_states) AS max_states, max(n_us_regions) AS max_regions,
  least(min(n_sites), min(n_us_states), min(n_us_regions)) AS min_any FROM geo""")
def q_geo_guards(spark, sf_dir):
    """The numeric block passes its guards; the numbers they look at."""
    from cohortspark.operators.geo import numeric_guardrails
    r = numeric_guardrails(numeric_block(cleaned_trials(spark, sf_dir), NUMERIC_COLS).select(*NUMERIC_COLS))
    return spark.createDataFrame([tuple(int(r[k]) for k in ("max_sites", "max_states", "max_regions", "min_any"))], "max_sites int, max_states int, max_regions int, min_any int")


@register("hurdle_clip_after", _HURDLE_BASE + """
SELECT row_id, copy_no, round(least(greatest(p * y_cond, 0e0), 1e0), 6) AS y_pred, round(y_cond, 6) AS y_cond FROM hin""")
def q_hurdle_clip_after(spark, sf_dir):
    """The variant that clips the product only."""
    h = _hurdle_inputs(spark, sf_dir)
    out = hurdle_combine(F.col("p"), F.col("y_cond"), clip_amount=False)
    return h.select(*ROW_KEY, out["y_pred"].alias("y_pred"), out["y_cond"].alias("y_cond"))


@register("attr_sparse_pivot", _ATTR_BASE.replace("gl AS (", "gx AS (") + f""", bs AS (SELECT target, {_sql_group('feature')} AS g, sum(abs(value)) / (SELECT count(*) FROM embeddings) AS s
  FROM lng WHERE abs(value) >= {_SPARSE} AND feature NOT LIKE '%7' GROUP BY 1, 2),
fs AS (SELECT {_sql_group('feature')} AS g, count(*) AS n FROM (SELECT unnest({_sql_list(ATTR_NAMES)}) AS feature) GROUP BY 1)
SELECT target, {", ".join(f"round(coalesce(sum(s / n) FILTER (WHERE g = {O.q(g)}), 0e0), 6) AS {chr(34) + g + chr(34)}" for g in A.GROUP_ORDER)}
FROM bs JOIN fs USING (g) GROUP BY target""")
def q_attr_sparse_pivot(spark, sf_dir):
    """A16 on a sparse table: the mean over all features of a group, columns by falling mass."""
    long = _attr_long(spark, sf_dir)
    kept = long.where((F.abs("value") >= _SPARSE) & ~F.col("feature").endswith("7"))
    by_target = A.mean_abs_by_target(kept, read_table(spark, sf_dir, "embeddings").count())
    group = A.feature_group(F.col("feature"))
    order = A.groups_by_mass(by_target, group)
    order += [g for g in A.GROUP_ORDER if g not in order]
    return A.group_pivot(by_target, group, how="mean", groups=order, features=spark.createDataFrame([(x,) for x in ATTR_NAMES], "feature string"))


@register("array_round_trip", "SELECT vec_id, embedding[1] AS first, embedding[len(embedding)] AS last, len(embedding) AS n FROM embeddings")
def q_array_round_trip(spark, sf_dir):
    """IO12: arrays written and read back."""
    path = TJ.scratch_dir(spark, "arrays") + ".parquet"
    save_dataframe(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), path)
    back = load_dataframe(spark, path)
    return back.select("vec_id", F.col("embedding")[0].alias("first"), F.element_at("embedding", -1).alias("last"), F.size("embedding").cast("long").alias("n"))
