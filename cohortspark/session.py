"""Spark session helpers shared by jobs, tests and the bench."""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "cohortspark",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return (or build) a session with the settings this library relies on.

    On a cluster the session already exists and is returned as is; the
    builder options only matter for local runs and tests.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    cpus = os.cpu_count() or 8
    builder = (
        builder
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; only when that is
    unset in a local session (tests) a fresh scratch folder is created here.
    On a cluster a missing setting is an error: a folder of one machine would not do.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="cohortspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def drop_dead_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Spark removes the shuffle files of a query when the query ends.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Inputs of a join that lie by one of its keys already are dealt out anew by all of them.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def shuffles_end_with_jobs(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files; without this they last until the driver's next garbage collection."""
    with _setting(spark, FILE_CLEANUP, "true"):
        yield


@contextmanager
def joins_keep_dealt_rows(spark: SparkSession) -> Iterator[None]:
    """Joins that run inside take inputs as they lie if both are dealt out by the same one of the join's keys."""
    with _setting(spark, ALL_KEYS, "false"):
        yield
