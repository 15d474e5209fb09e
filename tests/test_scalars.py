"""Literal edge tables for the scalar rules (age parse, categories, text merge, states)."""

import math

from pyspark.sql import functions as F

from cohortspark.functions.age import parse_age
from cohortspark.functions.categorical import normalize_categorical
from cohortspark.functions.geo import extract_us_states, n_us_regions
from cohortspark.functions.text import merge_text

INF = float("inf")
AGE_CASES = [
    (None, None), ("18", 18.0), ("18 Years", 18.0), ("18 yrs", 18.0), ("18y", 18.0),
    ("18 Y", 18.0), ("70 YEARS", 70.0), (">=21", 21.0), ("65+", 65.0), ("~ 30 +", 30.0),
    ("< 5 years", 5.0), ("-5", -5.0), ("6 Months", None), ("10 Days", None), ("N/A", None),
    ("", None), ("  ", None), ("nan", None), ("None", None), ("NULL", None), ("18d", None),
    ("18f", None), ("1e2", 100.0), ("1_000", 1000.0), ("inf", INF), ("-inf", -INF),
    ("infinity", None), ("+nan", None), ("55.5 yr", 55.5), ("18-65", None),
    ("yearsyears 7", 7.0), ("1__0", None), ("5.", 5.0), (".5", 0.5), ("18 yEars", None),
    ("0x10", None),
]


def test_parse_age_edge_table(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(AGE_CASES)], "i int, s string")
    got = {r["i"]: r["y"] for r in df.select("i", parse_age("s", df.schema["s"].dataType).alias("y")).collect()}
    for i, (s, want) in enumerate(AGE_CASES):
        y = got[i]
        if want is None:
            assert y is None, (s, y)
        else:
            assert y is not None and (y == want or (math.isinf(want) and y == want)), (s, y)


def test_parse_age_numeric_input(spark):
    df = spark.createDataFrame([(18.0,), (float("nan"),), (None,)], "a double")
    got = [r[0] for r in df.select(parse_age("a", df.schema["a"].dataType)).collect()]
    assert got == [18.0, None, None]


def test_categorical_rule(spark):
    vals = [None, "nan", "None", "", "NaN", " None ", "unknown", "Unknown", "DOUBLE"]
    df = spark.createDataFrame([(v,) for v in vals], "c string")
    got = [r[0] for r in df.select(normalize_categorical("c", "UNK")).collect()]
    assert got == ["UNK", "UNK", "UNK", "UNK", "NaN", " None ", "unknown", "UNK", "DOUBLE"]


def test_merge_text(spark):
    row = ("a  b", None, "c\t", "", "d\n", "b\x1cc", "nan")
    df = spark.createDataFrame([row], "t1 string, t2 string, t3 string, t5 string, t6 string, t7 string, t8 string")
    got = df.select(merge_text(["t1", "t2", "t3", "t5", "t6"], ["t1", "t2", "t3", "t4", "t5", "t6"])).first()[0]
    assert got == "a b c d"
    assert df.select(merge_text(["t7", "t8"])).first()[0] == "b c nan"
    assert df.select(merge_text(["t2"], ["t2", "t4"])).first()[0] == ""


def test_states_and_regions(spark):
    cases = [("Boston, MA, US; Austin, TX; Worcester, MA", ["MA", "TX"], 2),
             ("MAINE xCAx ca", [], 0), (None, [], 0),
             ("Site A CA|Site B NV|Site C WA", ["CA", "NV", "WA"], 1),
             ("NY NJ IL FL", ["FL", "IL", "NJ", "NY"], 3),
             ("OR IN ME OK HI", ["HI", "IN", "ME", "OK", "OR"], 4)]
    df = spark.createDataFrame([(c[0],) for c in cases], "loc string")
    out = df.select(extract_us_states("loc").alias("s")).select("s", n_us_regions(F.col("s")).alias("r")).collect()
    for (loc, states, regions), row in zip(cases, out):
        assert list(row["s"]) == states, loc
        assert row["r"] == regions, loc


def test_parse_age_notebook_variant(spark):
    from cohortspark.functions.age import with_parsed_ages
    cases = [("18 Years", 18.0), (">=21", None), ("65+", None), ("40 yrs", 40.0), ("70 YEARS", None),
             ("55.5 yr", 55.5), ("75 Y", 75.0), ("nan", None), ("", None), (None, None)]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, s string")
    got = {r["i"]: r["y"] for r in with_parsed_ages(df, {"y": "s"}, variant="notebook").collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_runs_of_any_whitespace_collapse(spark):
    """Merged text equals Python's split and join, whatever the runs, and single spaces are no match of the pattern."""
    import random
    import re
    from cohortspark.functions import text as X
    rng = random.Random(1)
    signs = [*X.WHITESPACE_CHARS, *" " * 20, *"abé​’_0~!\x7f\x01"]
    rows = [tuple("".join(rng.choice(signs) for _ in range(rng.randint(0, 9))) if rng.random() < 0.8 else None for _ in range(3)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    for r in df.select("*", X.merge_text(["a", "b", "c"], ["a", "x", "b", "c"]).alias("m")).collect():
        assert r["m"] == " ".join(" ".join(r[c] or "" for c in "abc").split())
    assert re.findall(X._ASCII_RUNS, "one two  three\nfour") == ["  ", "\n"]
