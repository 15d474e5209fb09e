"""The written trial view: the rows of its SQL, each document's text on disk a bounded number of times."""

import importlib
import os
import random

import pytest

TV = importlib.import_module("cohortspark.sources.trials_view")
N_ORDERS, N_DOCS = 1800, 60


@pytest.fixture
def tables(spark, tmp_path):
    rnd = random.Random(5)
    text = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=40_000)) for _ in range(N_DOCS)]
    docs = [(i, text[i]) for i in range(N_DOCS - 3)] + [(3, text[57]), (4, None), (None, text[58])]  # repeated ids, null text, null id
    made = {
        "orders": ([(i, i % 7, "O", "1-URGENT") for i in range(N_ORDERS)] + [(5, 1, "F", "2-HIGH"), (None, 1, "F", "2-HIGH")],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"),
        "customer": ([(i, f"c{i}", i % 2, "AUTO") for i in range(7)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "nation": ([(0, "X", 0), (1, "Y", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
        "part": ([(i, f"p{i}", "b", "t") for i in range(11)], "p_partkey long, p_name string, p_brand string, p_type string"),
        "documents": (docs, "doc_id long, text string"),
        "benchmark": ([(0, "item a"), (1, "item b"), (1, "item b"), (2, None)], "item_id long, text string"),
        "lineitem": ([(i % N_ORDERS, 3.0, "N", "O", 0.1, 0.02) for i in range(2 * N_ORDERS)] + [(None, 1.0, "A", "F", 0.0, 0.0)],
                     "l_orderkey long, l_quantity double, l_returnflag string, l_linestatus string, l_discount double, l_tax double"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path), sum(len(t or "") for _, t in docs)


def _bytes(path):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(path) for f in files)


def _shuffle_bytes(spark):
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_"))


def test_writing_the_view_leaves_no_shuffle_files(spark, tables, monkeypatch, tmp_path):
    sf_dir, _ = tables
    monkeypatch.setattr(TV, "drop_dead_shuffles", lambda spark: None)  # no garbage collection to wait for
    TV.drop_dead_shuffles(spark)
    before = _shuffle_bytes(spark)
    TV._write_view(spark, sf_dir, f"{tmp_path}/view.parquet")
    assert _shuffle_bytes(spark) - before < 10_000


def test_no_shuffle_carries_columns_that_follow_from_others(spark, tables):
    sf_dir, _ = tables
    try:
        rows = TV._rows_by_text(spark, TV.register_tables(spark, sf_dir, TV.TRIAL_TABLES))
        below = rows._jdf.queryExecution().optimizedPlan().toString().split("Join ", 1)[1]
    finally:
        TV.register_tables(spark, sf_dir, TV.TRIAL_TABLES)
    for column in ("nct_id", "eligibility_min_age", "eligibility_max_age", "eligibility_sex", "masking", "Locations", "interventions_text"):
        assert f" AS {column}#" not in below


def test_written_view_has_the_rows_of_its_sql_and_each_text_once(spark, tables, monkeypatch, tmp_path):
    sf_dir, text_bytes = tables
    monkeypatch.setattr(TV, "SLICE_ORDERS", 700, raising=False)  # three steps
    view, plain = TV.trials_view(spark, sf_dir), TV.trials_view(spark, sf_dir, materialize=False)
    assert view.dtypes == plain.dtypes and plain.count() > N_ORDERS
    assert view.exceptAll(plain).isEmpty() and plain.exceptAll(view).isEmpty()
    assert spark.table("orders").count() == N_ORDERS + 2  # the names stand for the whole tables
    assert _bytes(TV.trials_path(spark, sf_dir)) < 2 * text_bytes  # some 30 rows hold each text
    copy = f"{tmp_path}/copy.parquet"
    TV.write_trials(view, copy)
    assert _bytes(copy) < 4 * text_bytes


def test_rows_lines_and_documents_are_dealt_out_once(spark, tables):
    sf_dir, _ = tables
    with TV.joins_keep_dealt_rows(spark):
        rows = TV._rows_by_text(spark, TV.register_tables(spark, sf_dir, TV.TRIAL_TABLES))
        plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3  # the other tables are small here
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_a_step_reads_its_own_documents(spark, tables, monkeypatch, tmp_path):
    sf_dir, _ = tables
    monkeypatch.setattr(TV, "SLICE_ORDERS", 700)  # three steps
    read, whole = [], TV._rows_by_text
    monkeypatch.setattr(TV, "_rows_by_text", lambda spark, part, *a: (read.append(part["documents"].count()), whole(spark, part, *a))[1])
    TV._write_view(spark, sf_dir, f"{tmp_path}/view.parquet")
    assert len(read) == 3 and sum(read) <= N_DOCS


@pytest.mark.parametrize("empty", ["documents", "benchmark", "part"])
def test_written_view_has_the_rows_of_its_sql_without_one_table(spark, tables, monkeypatch, empty):
    sf_dir, _ = tables
    monkeypatch.setattr(TV, "SLICE_ORDERS", 700)
    spark.read.parquet(f"{sf_dir}/{empty}.parquet").limit(0).write.parquet(f"{sf_dir}/none")
    spark.read.parquet(f"{sf_dir}/none").write.mode("overwrite").parquet(f"{sf_dir}/{empty}.parquet")
    view, plain = TV.trials_view(spark, sf_dir), TV.trials_view(spark, sf_dir, materialize=False)
    assert view.dtypes == plain.dtypes and plain.isEmpty() == (empty == "part")
    assert view.exceptAll(plain).isEmpty() and plain.exceptAll(view).isEmpty()
