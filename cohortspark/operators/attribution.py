"""Attribution roll-ups over a long table ``(key, target, feature, value)`` (X5, A10-A17, L1-L4, W1, F17, F18, IO13).

The per-row attribution tensor never exists: every table here is an
aggregate keyed by (feature), (target, feature) or (group[, target]).
Partial aggregation runs before each shuffle, so the shuffled volume is
bounded by features × targets per task, whatever the row count or skew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.schema import CAT_COLS, REQUIRED_GEO_NUMERIC_COLS

# Display names, group labels and rules of the notebook roll-up.
GEO_LABELS = {"n_sites": "# recruiting sites", "n_us_states": "# U.S. states",
              "n_us_regions": "# U.S. Census regions"}
EMBED_LABEL_PREFIX = "text_embed_"
GROUP_TEXT = "Protocol narrative text (embeddings)"
GROUP_ELIGIBILITY = "Eligibility constraints"
GROUP_SCOPE = "Recruitment scope (U.S.-only)"
GROUP_DESIGN = "Trial design attributes"
GROUP_OTHER = "Other / uncategorized"
GROUP_ORDER = [GROUP_TEXT, GROUP_ELIGIBILITY, GROUP_SCOPE, GROUP_DESIGN, GROUP_OTHER]
DESIGN_ROOTS = ["phases_", "funder_type_", "study_type_", "allocation_", "intervention_model_",
                "masking_", "primary_purpose_", "sponsor_", "collaborators_"]
# Embedding features: script names ``text_emb_NNN``; notebook names digits or ``text_embed_N``.
EMBED_PREFIXES = ["text_emb_", "text_embed_"]


def is_embedding(f: Column) -> Column:
    cond = f.rlike(r"^[0-9]+$")
    for p in EMBED_PREFIXES:
        cond = cond | f.startswith(p)
    return cond


def feature_group(f: Column) -> Column:
    """ordered rules, first match wins."""
    design = F.lit(False)
    for r in DESIGN_ROOTS:
        design = design | f.startswith(r)
    return (F.when(is_embedding(f), F.lit(GROUP_TEXT))
            .when(f.startswith("eligibility_") | f.contains("age"), F.lit(GROUP_ELIGIBILITY))
            .when(f.isin(*REQUIRED_GEO_NUMERIC_COLS), F.lit(GROUP_SCOPE))
            .when(design, F.lit(GROUP_DESIGN))
            .otherwise(F.lit(GROUP_OTHER)))


def block_group(f: Column, num_cols: Sequence[str]) -> Column:
    """Script grouping by feature block: numeric / categorical_onehot / text_embeddings."""
    return (F.when(f.isin(*num_cols), F.lit("numeric"))
            .when(f.startswith("text_emb_"), F.lit("text_embeddings"))
            .otherwise(F.lit("categorical_onehot")))


def python_title(s: Column) -> Column:
    """Python ``str.title()``: a letter is upper-cased after a non-letter, else lower-cased."""
    chars = F.split(s, "")
    out = F.transform(chars, lambda c, i: F.when(
        (i == 0) | ~F.coalesce(F.get(chars, i - 1).rlike(r"^\p{L}$"), F.lit(False)),
        F.upper(c)).otherwise(F.lower(c)))
    return F.array_join(out, "")


def pretty_feature_name(f: Column) -> Column:
    """digits → text_embed_N; the three geography names fixed; else
    underscores → spaces, stripped, title-cased."""
    geo = F.create_map(*[x for k, v in GEO_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return (F.when(f.rlike(r"^[0-9]+$"), F.concat(F.lit(EMBED_LABEL_PREFIX), f))
            .when(f.isin(*GEO_LABELS), geo[f])
            .otherwise(python_title(F.trim(F.regexp_replace(f, "_", " ")))))


def mean_abs_by_target(long: DataFrame, n_rows: int | None = None) -> DataFrame:
    """A10: ``(target, feature, mean_abs)`` = mean over rows of |value|.

    A sparse table leaves zeros out; then ``n_rows`` names the number of explained rows to divide by.
    """
    mean = F.avg(F.abs("value")) if n_rows is None else F.sum(F.abs("value")) / F.lit(n_rows)
    return long.groupBy("target", "feature").agg(mean.alias("mean_abs"))


def global_importance(by_target: DataFrame, n_targets: int | None = None, features: DataFrame | None = None) -> DataFrame:
    """Mean over targets of the per-target mean |value| → ``(feature, mean_abs_shap)``.

    For a sparse table give ``n_targets`` to divide by and the model's ``features`` (one column
    ``feature``): those without any value get 0.
    """
    mean = F.avg("mean_abs") if n_targets is None else F.sum("mean_abs") / F.lit(n_targets)
    out = by_target.groupBy("feature").agg(mean.alias("mean_abs_shap"))
    if features is None:
        return out
    return features.select("feature").join(out, "feature", "left").withColumn("mean_abs_shap", F.coalesce("mean_abs_shap", F.lit(0.0)))


def sorted_groups(mass: DataFrame) -> DataFrame:
    """L2: groups by falling mass, ties by name."""
    return mass.orderBy(F.desc("mean_abs_shap_sum"), "group")


def group_mass(glob: DataFrame, group: Column, *, with_median: bool = False) -> DataFrame:
    """Per group sum, count, mean (and median) of the global importances."""
    aggs = [F.sum("mean_abs_shap").alias("mean_abs_shap_sum"),
            F.count(F.lit(1)).alias("n_features"),
            F.avg("mean_abs_shap").alias("mean_abs_shap_per_feature")]
    if with_median:
        aggs.append(F.median("mean_abs_shap").alias("median_abs_shap_per_feature"))
    return glob.withColumn("group", group).groupBy("group").agg(*aggs)


def group_by_target(by_target: DataFrame, group: Column, features: DataFrame | None = None,
                    targets: Sequence[str] | None = None) -> DataFrame:
    """``(group, target, sum_mean_abs_shap)``.

    For a sparse table give the model's ``features`` and ``targets``: cells without any value get 0.
    """
    out = (by_target.withColumn("group", group).groupBy("group", "target")
           .agg(F.sum("mean_abs").alias("sum_mean_abs_shap")))
    if features is None:
        return out
    cells = features.select(group.alias("group")).distinct().select("group", F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"))
    return cells.join(out, ["group", "target"], "left").withColumn("sum_mean_abs_shap", F.coalesce("sum_mean_abs_shap", F.lit(0.0)))


def groups_by_mass(by_target: DataFrame, group: Column) -> list[str]:
    """Groups by falling mass, ties by name (a handful: the groups are fixed by the rule that makes them)."""
    mass = by_target.groupBy(group.alias("group")).agg(F.sum("mean_abs").alias("mass"))
    return [r["group"] for r in mass.orderBy(F.desc("mass"), "group").collect()]


def group_pivot(by_target: DataFrame, group: Column, *, how: str = "sum",
                groups: Sequence[str] = GROUP_ORDER, features: DataFrame | None = None) -> DataFrame:
    """Target × group table, missing cells 0, columns in the order of ``groups`` (always given to the pivot).

    The mean divides by the features present, or, for a sparse table, by all of the group's ``features``.
    """
    agg = F.sum("mean_abs") if how == "sum" or features is not None else F.avg("mean_abs")
    wide = by_target.withColumn("group", group).groupBy("target").pivot("group", list(groups)).agg(agg)
    size = {}
    if how == "mean" and features is not None:
        size = {r["group"]: r["n"] for r in features.groupBy(group.alias("group")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return wide.select("target", *[(F.coalesce(F.col(f"`{g}`"), F.lit(0.0)) / F.lit(float(size.get(g, 1)))).alias(g) for g in groups])


def top_k_per_target(by_target: DataFrame, k: int = 25) -> DataFrame:
    """Rank features within each target by mean |value| (ties by name), keep k."""
    w = Window.partitionBy("target").orderBy(F.desc("mean_abs"), "feature")
    return by_target.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_structured(glob: DataFrame, k: int = 50) -> DataFrame:
    """L3/L4: top-k non-embedding features by global importance (TakeOrderedAndProject)."""
    return (glob.where(~F.col("feature").startswith("text_emb_"))
                .orderBy(F.desc("mean_abs_shap"), "feature").limit(k))


def ranked_importance(by_target: DataFrame, k: int = 25) -> DataFrame:
    """IO13: one row per target with its top-k ``[{feature, mean_abs_shap}]`` list."""
    top = top_k_per_target(by_target, k)
    return (top.groupBy("target").agg(F.sort_array(F.collect_list(F.struct(
        F.col("rank"), F.col("feature"), F.col("mean_abs").alias("mean_abs_shap")))).alias("items"))
        .select("target", F.transform("items", lambda s: F.struct(
            s["feature"].alias("feature"), s["mean_abs_shap"].alias("mean_abs_shap"))).alias("features")))


def write_ranked_json(by_target: DataFrame, path: str, k: int = 25) -> None:
    ranked_importance(by_target, k).coalesce(1).write.mode("overwrite").json(path)


def default_feature_layout(dim: int, num_cols: Sequence[str], cat_cols: Sequence[str] = CAT_COLS,
                           level: str = "Unknown") -> list[str]:
    """Names for a ``dim``-wide attribution vector laid out as [numeric, one-hot, text]."""
    names = list(num_cols) + [f"{c}_{level}" for c in cat_cols]
    if len(names) > dim:
        raise ValueError(f"{len(names)} named features do not fit into {dim}")
    return names + [f"text_emb_{i:03d}" for i in range(dim - len(names))]


def attributions_for_target(long: DataFrame, target: str) -> DataFrame:
    """One target's slice of the long attribution table."""
    return long.where(F.col("target") == F.lit(target)).drop("target")
