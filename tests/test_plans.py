"""Plan-shape guards for the scale design (checked on the physical plan, sf0.001)."""

import __spark_entry__ as E
from cohortspark.operators.embed import hashed_embedding
from cohortspark.plans.prepare import split_trials
from cohortspark.sources.trials_view import trials_view

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ood_scoring_reads_pruned_columns_without_cartesian(spark):
    p = plan(E.queries()["ood_scores"](spark, SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "Locations" in p and "inclusion_text" not in p  # pruned scan


def test_split_has_no_global_window(spark):
    p = plan(split_trials(spark, SMALL))
    # any Window is partitioned by bucket (only straddle buckets), never unpartitioned
    for line in p.splitlines():
        if "Window [" in line:
            assert "_sb" in line


def test_text_vectors_need_no_shuffle(spark):
    t = trials_view(spark, SMALL).select("row_id", "copy_no", "inclusion_text")
    p = plan(hashed_embedding(t, ["row_id", "copy_no"], "inclusion_text", dim=32))
    assert "Exchange" not in p and "Join" not in p


def test_mean_baseline_is_a_projection(spark):
    from cohortspark.operators.baselines import mean_baseline
    from cohortspark.operators.metrics import extract_targets
    from cohortspark.schema import TARGET_COLS
    s = extract_targets(split_trials(spark, SMALL), TARGET_COLS)
    p = plan(mean_baseline(s, TARGET_COLS))
    assert "CartesianProduct" not in p and "NestedLoop" not in p
