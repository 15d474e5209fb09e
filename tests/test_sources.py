"""Sources and sinks: Feather round trip, suffix dispatch, CSV with declared schema."""

import os
import tempfile

import pyarrow as pa
import pyarrow.feather as feather
import pytest

from cohortspark.sources.readers import load_dataframe
from cohortspark.sources.writers import save_dataframe


def test_feather_read_multi_file_and_round_trip(spark):
    d = tempfile.mkdtemp(prefix="cs-feather-")
    for i in range(3):
        feather.write_feather(pa.table({"nct_id": [f"N{i}{j}" for j in range(4)], "x": [float(j) for j in range(4)]}),
                              os.path.join(d, f"f{i}.feather"))
    df = load_dataframe(spark, os.path.join(d, "*.feather"))
    assert df.rdd.getNumPartitions() == 3
    assert df.count() == 12
    out = os.path.join(tempfile.mkdtemp(prefix="cs-feather-out-"), "t.feather")
    save_dataframe(df.repartition(2), out)
    back = load_dataframe(spark, out)
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_csv_and_unknown_suffix(spark):
    d = tempfile.mkdtemp(prefix="cs-csv-")
    p = os.path.join(d, "t.csv")
    with open(p, "w") as fh:
        fh.write('nct_id,eligibility_min_age,notes\nA,18 Years,"multi\nline"\nB,65+,x\n')
    df = load_dataframe(spark, p)
    assert [r["eligibility_min_age"] for r in df.orderBy("nct_id").collect()] == ["18 Years", "65+"]
    with pytest.raises(ValueError):
        load_dataframe(spark, os.path.join(d, "t.xlsx"))


def test_keyed_sink_and_report_table(spark):
    import glob
    from cohortspark.sources.writers import save_keyed, save_table
    d = tempfile.mkdtemp(prefix="cs-sinks-")
    df = spark.createDataFrame([(1, 0.25, True), (2, 0.5, False)], "nct_id int, ood_score double, ood_warn boolean")
    save_keyed(df, os.path.join(d, "pred.parquet"), "nct_id", ["ood_score", "ood_warn"])
    back = spark.read.parquet(os.path.join(d, "pred.parquet"))
    assert back.columns == ["nct_id", "ood_score", "ood_warn"]
    assert dict(back.dtypes)["nct_id"] == "string"
    save_table(df, os.path.join(d, "report"))
    files = glob.glob(os.path.join(d, "report", "part-*.csv"))
    assert len(files) == 1 and open(files[0]).readline().strip() == "nct_id,ood_score,ood_warn"


def test_feather_files_are_compressed_and_take_a_file_uri(spark, tmp_path):
    import os

    rows = spark.range(20_000).selectExpr("id", "'Boston, MA, US; Austin, TX; Worcester, MA' AS place")
    save_dataframe(rows.coalesce(1), f"file://{tmp_path}/t.feather")
    files = [os.path.join(at, f) for at, _, names in os.walk(f"{tmp_path}/t.feather") for f in names]
    assert 0 < sum(map(os.path.getsize, files)) < 20_000 * 20  # the place alone is 41 bytes
    back = load_dataframe(spark, f"file://{tmp_path}/t.feather")
    assert back.count() == 20_000 and rows.exceptAll(back).isEmpty()
