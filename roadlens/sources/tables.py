"""Reading and writing tables through any Spark connector."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(
    spark: SparkSession,
    name: str,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
    path_option: str | None = None,
) -> DataFrame:
    """Lazy scan of one table.

    File formats take ``name`` as a path. Warehouse connectors take it through an
    option, e.g. ``path_option="dbtable"``, with their account settings in
    ``options``."""
    reader = spark.read.format(fmt).options(**dict(options or {}))
    if path_option is None:
        return reader.load(name)
    return reader.option(path_option, name).load()


def read_tables(
    spark: SparkSession,
    names: Iterable[str],
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
    path_option: str | None = None,
    prefix: str = "",
    suffix: str = "",
) -> dict[str, DataFrame]:
    """One lazy scan per listed name, keyed by that name."""
    return {n: read_table(spark, f"{prefix}{n}{suffix}", fmt, options, path_option) for n in names}


def _writer(df: DataFrame, fmt: str, options: Mapping[str, str] | None, mode: str):
    return df.write.format(fmt).options(**dict(options or {})).mode(mode)


def write_overwrite(
    df: DataFrame,
    name: str,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
    path_option: str | None = None,
) -> None:
    """Replace the target table with ``df``."""
    writer = _writer(df, fmt, options, "overwrite")
    writer.save(name) if path_option is None else writer.option(path_option, name).save()


def write_append(
    df: DataFrame,
    name: str,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
    path_option: str | None = None,
) -> None:
    """Add the rows of ``df`` to a table that already exists.

    Columns are matched by name and cast to the table's types, so a second part
    with the same columns in another order cannot land in the wrong place."""
    existing = read_table(df.sparkSession, name, fmt, options, path_option).schema
    wanted, given = set(existing.names), set(df.columns)
    if wanted != given:
        raise ValueError(
            f"append needs the same columns; missing {sorted(wanted - given)}, "
            f"unexpected {sorted(given - wanted)}"
        )
    aligned = df.select([df[f.name].cast(f.dataType).alias(f.name) for f in existing])
    writer = _writer(aligned, fmt, options, "append")
    writer.save(name) if path_option is None else writer.option(path_option, name).save()


def write_part(
    df: DataFrame,
    name: str,
    part: str,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
    column: str = "part",
) -> None:
    """Write ``df`` as one part of a table of files, in place of what this part held before.

    A part is a partition of its own, named in ``column``, and other parts stay as they are.
    So a write that failed, or may have, is simply done again: unlike an append it cannot
    leave rows twice. Parts may differ in the order of their columns."""
    if column in df.columns:
        raise ValueError(f"the rows have a column {column} already")
    marked = df.select(*sorted(df.columns), F.lit(part).alias(column))
    writer = _writer(marked, fmt, options, "overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(column).save(name)


def inline_rows(
    spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType
) -> DataFrame:
    """A DataFrame of literal rows."""
    return spark.createDataFrame(list(rows), schema)
