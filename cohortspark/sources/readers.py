"""IO1-IO4: read by suffix (CSV with a declared schema, Parquet, Feather)."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TEST_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register_tables(spark: SparkSession, sf_dir: str,
                    names: Iterable[str] = TEST_TABLES) -> dict[str, DataFrame]:
    """Register each parquet table as a temp view named after it."""
    out = {}
    for n in names:
        df = read_table(spark, sf_dir, n)
        df.createOrReplaceTempView(n)
        out[n] = df
    return out


def _suffix(path: str) -> str:
    p = path.rstrip("/").lower()
    for suf in (".csv", ".parquet", ".pq", ".feather", ".arrow", ".ipc"):
        if p.endswith(suf):
            return suf
    return ""


def load_dataframe(spark: SparkSession, path: str, *,
                   schema: T.StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    """Read a trial table; the format follows the file suffix.

    CSV is read with a declared schema when given (no inference pass on
    large data); without one every column is read as string, which keeps
    mixed number/text age columns intact for the age parser. Quoted line
    breaks are read right by default, which takes one task per file; a file
    without any can be split over tasks with ``multi_line=False``.
    """
    suf = _suffix(path)
    if suf == ".csv":
        reader = (spark.read.option("header", True).option("escape", '"')
                  .option("multiLine", multi_line))
        if schema is not None:
            reader = reader.schema(schema)
        return reader.csv(path)
    if suf in (".parquet", ".pq"):
        reader = spark.read
        if schema is not None:
            reader = reader.schema(schema)
        return reader.parquet(path)
    if suf in (".feather", ".arrow", ".ipc"):
        from cohortspark.sources.feather import register_feather_source
        register_feather_source(spark)
        reader = spark.read.format("feather")
        if schema is not None:
            reader = reader.schema(schema)
        return reader.load(path)
    raise ValueError(f"Unsupported file type for {path!r}: use .csv, .parquet/.pq or .feather")
