"""Driver contract: entry runs; every oracle key is a query; a sample of oracles agrees at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from cohortspark.sources.readers import TEST_TABLES

SMALL = "/root/testdata/sf0.001"


def test_entry_and_contract(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def _key(t):
    return tuple((x is None, round(x, 4) if isinstance(x, float) else ("" if x is None else str(x))) for x in t)


@pytest.mark.parametrize("name", ["clean_ages", "geo_counts", "split_exact", "ood_scores", "baseline_union",
                                  "knn_predict", "onehot_long", "attr_pivot", "text_embedding"])
def test_oracle_agrees_small(spark, name):
    con = duckdb.connect()
    for t in TEST_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = E.queries()[name](spark, SMALL)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=_key)
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    want = sorted((tuple(r[i] for i in order) for r in res.fetchall()), key=_key)
    assert sorted(df.columns) == sorted(cols)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, float):
                assert x == pytest.approx(y, abs=2e-6)
            else:
                assert x == y
