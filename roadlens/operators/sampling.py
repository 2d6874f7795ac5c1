"""Repeatable splits and samples: the choice depends on the rows' keys only, not on
partitioning, task order or re-execution."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from roadlens.functions.columns import hash_number, hash_percent
from roadlens.operators.quantiles import bracket_of, counts_in, quantile_sketch, values_at
from roadlens.session import materialize

ROW_SHIFT = 11  # of a row's 32-bit hash 21 bits are part of its place
REPEAT_STEP = 10_000


def with_split(
    df: DataFrame, keys: Sequence[str], train_percent: int = 80, seed: int = 42,
    name: str = "split",
) -> DataFrame:
    """Add a ``train``/``test`` column."""
    is_train = hash_percent(seed, *keys) < train_percent
    return df.withColumn(name, F.when(is_train, "train").otherwise("test"))


def split_train_test(
    df: DataFrame, keys: Sequence[str], train_percent: int = 80, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Two frames of about ``train_percent`` and the rest; one key stays on one side."""
    is_train = hash_percent(seed, *keys) < train_percent
    return df.where(is_train), df.where(~is_train)


def repeat_rows(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as the column ``times`` says. Long repeats grow in two steps,
    so that no array has more than ``REPEAT_STEP`` entries."""
    steps = F.sequence(F.lit(0), F.floor((F.col(times) - 1) / REPEAT_STEP))
    left = F.col(times) - F.col("_step") * REPEAT_STEP
    return (
        df.where(F.col(times) > 0)
        .withColumn("_step", F.explode(steps))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(left, F.lit(REPEAT_STEP)))))
        .select(*df.columns)
    )


def _place(seed: int, keys: Sequence[str], columns: Sequence[str]) -> Column:
    """A row's place in hash order, a whole number of 53 bits: the keys' hash, then the
    leading bits of the row's, so that a key with many rows has many places."""
    row = F.shiftright(hash_number(seed, *columns), ROW_SHIFT)
    return (F.shiftleft(hash_number(seed, *keys), 32 - ROW_SHIFT) + row).cast("double")


def take_by_hash(
    df: DataFrame, size: Column, keys: Sequence[str], seed: int = 42,
    taken: Column | None = None, beside: Column | None = None,
) -> DataFrame:
    """The first ``size`` rows in order of the hash of ``keys``, then of the hash of the
    whole row and its values. Keys may repeat; equal rows are copies. With ``taken`` only
    rows that meet this condition are counted and taken, and ``size`` is an aggregate over
    all rows; rows that meet the condition ``beside`` come as well.

    The frame is read twice. One aggregate counts the rows and sketches their places in hash
    order, which encloses the last place taken between two; what lies up to the second,
    little more than the sample, is written, and the rest happens there: counts in the
    bracket give the last place, and only rows of that very place are ranked, after their
    copies have been counted together."""
    hashed = df.withColumn("_place", _place(seed, keys, df.columns))
    wanted = F.max(size) if taken is None else size
    taken, beside = (F.lit(True) if taken is None else taken), (F.lit(False) if beside is None else beside)
    place = F.when(taken, F.col("_place"))
    stats = hashed.agg(
        F.count(place).alias("n"), wanted.cast("bigint").alias("size"), quantile_sketch(place).alias("s")).first()
    n, limit = stats["n"], stats["size"] or 0
    if not n or limit <= 0:
        return df.where(beside)
    if limit >= n:
        return df.where(taken | beside)
    low, high = bracket_of(df, stats["s"], (limit - 1) / n)
    kept = materialize(hashed.where((place <= high) | beside))
    hit, = values_at(counts_in(kept, [(place, low, high)]), [(0, limit - 1)], n)
    if hit is None:  # very rare: the sketch was further off than its margin
        kept = hashed.where(taken | beside)
        hit, = values_at(counts_in(kept, [(place, -math.inf, math.inf)]), [(0, limit - 1)], n)
    last, before = hit
    order = W.orderBy("_row_hash", *df.columns).rowsBetween(W.unboundedPreceding, W.currentRow)
    ties = kept.where(place == last).drop("_place").withColumn("_row_hash", hash_number(seed, *df.columns))
    copies = (
        ties.groupBy("_row_hash", *df.columns).agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_before", F.sum("_copies").over(order) - F.col("_copies"))
        .withColumn("_taken", F.least("_copies", F.lit(limit - before) - F.col("_before")))
    )
    some = repeat_rows(copies.where("_taken > 0"), "_taken").select(*df.columns)
    return kept.where((place < last) | beside).select(*df.columns).unionByName(some)


def limit_ratio(
    df: DataFrame, label: str, keys: Sequence[str], ratio: int, seed: int = 42, positives: bool = False
) -> DataFrame:
    """Rows of class 0, at most ``ratio`` times the number of rows of class 1, and those as
    well if asked for ``positives``."""
    positive = F.col(label) == 1
    return take_by_hash(df, F.count_if(positive) * F.lit(ratio), keys, seed, F.col(label) == 0,
                        positive if positives else None)
