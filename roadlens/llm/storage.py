"""Shared storage for intermediate tables, and the package's place for Python workers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from roadlens.session import stored

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Freed large arrays go back to the system, so idle workers stay small.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(8 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20),
                 "MALLOC_ARENA_MAX": "1", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def let_workers_import(spark: SparkSession) -> None:
    """Put this package on the search path of the Python workers and have them return
    memory. On a cluster the package must be installed at the same place or shipped with
    ``--py-files``."""
    environment = spark.sparkContext.environment
    for name, value in WORKER_MEMORY.items():
        environment.setdefault(name, value)
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back, which cuts the
    lineage and outlives lost executors."""
    return stored(df, name)


def written_alone(df: DataFrame, name: str, **options) -> DataFrame:
    """As ``written``, but the shuffle files behind it go as soon as it is written, not when
    the driver next collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return stored(df, name, **options)
    finally:
        conf.set(CLEANUP, before)
