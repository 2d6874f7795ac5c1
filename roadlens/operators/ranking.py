"""Sorts, top and bottom k, one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec
from pyspark.sql import functions as F

from roadlens.session import materialize


def sort_desc(df: DataFrame, column: str, *ties: str) -> DataFrame:
    return df.orderBy(F.col(column).desc(), *ties)


def sort_asc(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*columns)


def top_k(df: DataFrame, column: str, ties: Sequence[str], k: int = 15) -> DataFrame:
    """The k largest; ``ties`` make the choice unique."""
    return df.orderBy(F.col(column).desc(), *ties).limit(k)


def bottom_k(df: DataFrame, column: str, ties: Sequence[str], k: int = 15) -> DataFrame:
    return df.orderBy(F.col(column).asc(), *ties).limit(k)


def rows_of_top_key(df: DataFrame, key: str) -> DataFrame:
    """Detail rows of the key with the most rows (first in key order among equals).
    The key is one row, so it is broadcast into the scan of the detail."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    top = top_k(counts, "_n", [key], 1).select(key)
    return df.join(F.broadcast(top), key, "left_semi")


def dedupe_by_key(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """One row per key: the smallest row in column order, nulls first.

    Equal rows collapse before the shuffle, and the smallest row is a partial
    aggregate, so a hot key never meets in one task."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    smallest = df.distinct().groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return smallest.select(*keys, "_row.*").select(*df.columns)


def running_totals(
    df: DataFrame, within: str, order: Sequence[Column], amount: str, name: str = "before"
) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows of equal ``within`` that come before, in
    a total order, however many there are.

    Rows are dealt by ranges of the order and summed inside their range; the ranges' sums,
    one row per range and value of ``within``, give what lies before. So no task holds more
    than a range. The ranges are written once, as their borders come from a sample."""
    ranged = df.repartitionByRange(F.col(within).asc(), *order)
    placed = materialize(ranged.withColumn("_range", F.spark_partition_id()))
    sums = placed.groupBy(within, "_range").agg(F.sum(amount).alias("_sum")).select(
        F.col(within).alias("_within"), F.col("_range").alias("_at"),
        F.sum("_sum").over(_frame(W.partitionBy(within).orderBy("_range"))).alias("_before"))
    inside = F.sum(amount).over(_frame(W.partitionBy(within, "_range").orderBy(*order)))
    summed = placed.withColumn("_inside", inside).join(
        F.broadcast(sums), F.col(within).eqNullSafe(F.col("_within")) & (F.col("_range") == F.col("_at")))
    before = F.coalesce("_before", F.lit(0)) + F.coalesce("_inside", F.lit(0))
    return summed.select(*df.columns, before.cast("bigint").alias(name))


def _frame(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(W.unboundedPreceding, -1)


def row_numbers(df: DataFrame, within: str, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` with the row number (from 0) of every row among those of equal ``within``, in
    a total order, by ``running_totals``."""
    counted = running_totals(df.withColumn("_one", F.lit(1)), within, order, "_one", name)
    return counted.drop("_one")
