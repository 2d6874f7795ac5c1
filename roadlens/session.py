"""Shared storage: where intermediate results may be written."""

from __future__ import annotations

import re
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_WRITTEN: dict[str, list[str]] = {}  # paths by application


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or where that is unset a
    folder of the application in the session's warehouse. A warehouse on the driver's own
    disk serves local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
        on_driver = re.match(r"(file:|/|[^:/]+$|[^:/]+/)", warehouse or "/")
        if not warehouse or on_driver and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = f"{warehouse.rstrip('/')}/shared-{spark.sparkContext.applicationId}"
    return folder.rstrip("/")


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has used. What is written there is
    removed by ``forget`` or ``clean``, at the latest when the driver's process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, place = _place(spark, path)
    files.mkdirs(place.getParent())
    files.mkdirs(place)
    files.deleteOnExit(place)
    if not spark.conf.get("spark.checkpoint.dir", None):
        files.deleteOnExit(place.getParent())
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, name: str = "rows", **options) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back, column metadata
    included. That cuts the lineage, outlives lost executors and still prunes columns.
    ``options`` are those of the writer."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).mode("append").parquet(path)
    # Parquet keeps columns' metadata, which a given schema cannot always carry
    plain = not any(field.metadata for field in df.schema)
    kept = (spark.read.schema(df.schema) if plain else spark.read).parquet(path)
    _PLACES[kept] = path
    return kept


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once so that several actions can read it."""
    return stored(df)


def discard(spark: SparkSession, path: str) -> None:
    """Remove what was written to a ``fresh_path``."""
    files, place = _place(spark, path)
    files.delete(place, True)
    _WRITTEN[spark.sparkContext.applicationId].remove(path)


def forget(df: DataFrame) -> None:
    """Remove what ``stored`` wrote for this frame, which nothing may read any more."""
    path = _PLACES.pop(df, None)
    if path is not None:
        discard(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Remove all that this application has written to the shared folder."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        files, place = _place(spark, path)
        files.delete(place, True)
