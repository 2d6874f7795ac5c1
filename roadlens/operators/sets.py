"""Set operations. Unions match columns by name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def union_missing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union in which a column absent on one side is null there."""
    return a.unionByName(b, allowMissingColumns=True)


def except_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct whole rows of ``a`` that are not in ``b``."""
    return a.subtract(b.select(*a.columns))


def except_keys_fill(
    listed: DataFrame, universe: DataFrame, key: str, constants: Mapping[str, object]
) -> DataFrame:
    """``listed`` plus one row for each key of ``universe`` it lacks, filled with
    constants."""
    missing = universe.select(key).subtract(listed.select(key))
    filled = missing.withColumns({n: F.lit(v) for n, v in constants.items()})
    return listed.unionByName(filled.select(*listed.columns))


def split_rows(df: DataFrame, condition) -> tuple[DataFrame, DataFrame]:
    """Rows where the condition holds, and all the others (null counts as no)."""
    holds = F.coalesce(condition, F.lit(False))
    return df.where(holds), df.where(~holds)
