"""Positions in a global order without a single-task window."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.session import checkpoint_dir

_ROW_BITS = 33  # of monotonically_increasing_id


def global_rank(df: DataFrame, *order: Column | str, rank_col: str = "rank", start: int = 1) -> DataFrame:
    """Append each row's position in ``order`` (a total order, or equal rows are numbered as they come).

    The rows are dealt by range and sorted inside their partitions; a row's
    position is its place there plus the sizes of the partitions before
    (one number per partition).
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"rank-{uuid.uuid4().hex}")
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path).withColumns({"_part": F.shiftright("_at", _ROW_BITS), "_row": F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)})
    base, seen = [], start
    for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
        base.append((r["_part"], seen))
        seen += r["n"]
    offsets = spark.createDataFrame(base, "_part long, _base long")
    return rows.join(F.broadcast(offsets), "_part").withColumn(rank_col, F.col("_base") + F.col("_row")).drop("_at", "_part", "_row", "_base")
