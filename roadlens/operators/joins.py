"""Joins. Equi joins are left to Spark's planner; the ones here whose detail side may
hold a hot key spread that key over many tasks."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.session import materialize

# frequent-key sketch: items tracked per partition, and Spark's limit on them
SKETCH_ITEMS = 16
SKETCH_LIMIT = 1_000_000
CELL_ROWS = 4096  # master rows that one array of a range join holds


def _keys(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def join_inner(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return left.join(right, on=on, how="inner")


def join_left(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return left.join(right, on=on, how="left")


def join_full(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Full outer join that keeps the key of either side."""
    return left.join(right, on=on, how="full")


def join_semi(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return left.join(right.select(*_keys(on)), on=on, how="left_semi")


def join_anti(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return left.join(right.select(*_keys(on)), on=on, how="left_anti")


def key_counts(df: DataFrame, on: str | Sequence[str], name: str = "count") -> DataFrame:
    return df.groupBy(*_keys(on)).agg(F.count(F.lit(1)).alias(name))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(
    df: DataFrame, on: str | Sequence[str], parts: int | None = None
) -> list[tuple[int, int]]:
    """Hashes of keys with more rows than an even share of ``parts`` partitions (the
    shuffle partitions by default), each with the number of such shares it fills.

    One pass keeps a sketch of frequent keys whose size depends on ``parts`` only, and
    nothing is shuffled but the sketches. It cannot miss a key that large while its size
    grows with ``parts`` (up to ``SKETCH_LIMIT`` items; beyond, only keys of a share that
    the sketch can tell are sure to be found), and fewer than ``parts`` keys can be. It steers
    spreading only and never drops a row."""
    parts = shuffle_partitions(df) if parts is None else parts
    tracked = min(SKETCH_ITEMS * parts, SKETCH_LIMIT)
    hashed = df.select(F.xxhash64(*_keys(on)).alias("_key"))
    found = hashed.agg(
        F.expr(f"approx_top_k(_key, {min(parts, tracked)}, {tracked})").alias("top"),
        F.count(F.lit(1)).alias("rows"),
    ).first()
    shares = [(item["item"], item["count"] * parts / found["rows"]) for item in found["top"]]
    return [(key, math.ceil(share)) for key, share in shares if share > 1]


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    hot: list[tuple[int, int]] | None = None,
) -> DataFrame:
    """Equi join whose left side may be skewed.

    A pass over the keys of the left side finds the hot ones. Without any, this is a
    plain join. Otherwise the rows of a hot key are dealt over salts, as many as the
    shuffle partitions its share would fill, and the matching right rows are repeated
    once per salt. Null keys match nothing and are dealt over all salts. The salt comes
    from the row and from the partition it was read in, so that equal rows are spread
    as well.

    ``hot`` is a list of hot keys already found, perhaps in a frame that is cheaper to
    read than ``left``; it steers the spreading and never the result."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot spread a {how} join")
    keys = _keys(on)
    found = hot_keys(left, keys) if hot is None else hot
    if not found:
        return left.join(right, keys, how)
    parts = shuffle_partitions(left)
    salted = F.broadcast(left.sparkSession.createDataFrame(found, "_key bigint, _salts int"))
    salts = F.coalesce("_salts", F.lit(1))
    any_null = reduce(or_, [F.col(k).isNull() for k in keys])
    number = F.pmod(F.xxhash64(*left.columns), F.lit(1 << 30)) + F.spark_partition_id()
    dealt = (
        left.withColumn("_key", F.xxhash64(*keys)).join(salted, "_key", "left")
        .select(*[F.col(c) for c in left.columns],
                F.pmod(number, F.when(any_null, parts).otherwise(salts)).cast("int").alias("_salt"))
    )
    # the right keys are hashed as the left key's type
    typed = [F.col(k).cast(left.schema[k].dataType) for k in keys]
    repeated = (
        right.withColumn("_key", F.xxhash64(*typed)).join(salted, "_key", "left")
        .select(*[F.col(c) for c in right.columns],
                F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    )
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")


def join_back_count(df: DataFrame, key: str, name: str = "count") -> DataFrame:
    """Every row with the number of rows that share its key."""
    return spread_join(df, key_counts(df, key, name), key)


def fold_scores(
    base: DataFrame, scores: Mapping[str, DataFrame], key: str, value: str = "prediction"
) -> DataFrame:
    """Add one column per score table, the mean score of the key.

    The tables are stacked and aggregated together, so any number of models costs one
    aggregation and one join, and repeated keys cannot multiply the base rows."""
    parts = [
        df.select(key, F.lit(name).alias("_model"), F.col(value).alias("_value"))
        for name, df in scores.items()
    ]
    stacked = reduce(DataFrame.unionByName, parts)
    per_key = stacked.groupBy(key).agg(
        *[F.avg(F.when(F.col("_model") == name, F.col("_value"))).alias(name) for name in scores]
    )
    return base.join(per_key, key, "left")


def packed_cells(
    master: DataFrame, on: Sequence[str], position: str, width: int, rows: int = CELL_ROWS
) -> DataFrame:
    """(on, _cell, _rows): the rows of every cell of ``width`` positions as one array in order
    of position. A cell of more than ``rows`` rows becomes several arrays of about that many."""
    cell = F.floor(F.col(position) / F.lit(width))
    rest = [c for c in master.columns if c not in on]
    placed = master.where(F.col(position).isNotNull()).select(
        *on, cell.alias("_cell"), F.struct(F.col(position).alias("_at"), *rest).alias("_row"))
    crowded = placed.groupBy(*on, "_cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).select(
        *on, "_cell", F.ceil(F.col("_n") / rows).cast("int").alias("_parts"))
    number = F.pmod(F.xxhash64("_row") + F.spark_partition_id(), F.coalesce("_parts", F.lit(1)))
    dealt = placed.join(crowded, [*on, "_cell"], "left").withColumn("_part", number)
    return dealt.groupBy(*on, "_cell", "_part").agg(
        F.sort_array(F.collect_list("_row")).alias("_rows")).drop("_part")


def join_range(
    ranges: DataFrame,
    master: DataFrame,
    on: str | Sequence[str],
    position: str,
    low: str = "lo",
    high: str = "hi",
    width: int = 64,
    hot: list[tuple[int, int]] | None = None,
) -> DataFrame:
    """Rows of ``master`` whose key equals the range's key and whose position lies in
    its closed range.

    Positions are cut into cells of ``width``, whose master rows are packed into arrays: a range
    meets one row per cell it touches, takes inner cells whole and a slice of the two at
    its ends, and only rows of the result are unpacked. A busy cell is spread. Unless ``hot``
    names the busy cells, the ranges are materialized, as both the search for those and
    the join read them."""
    def cell(name: str):
        return F.floor(F.col(name) / F.lit(width))

    keys = _keys(on)
    ranges = materialize(ranges) if hot is None else ranges
    touched = ranges.withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    joined = spread_join(touched, packed_cells(master, keys, position, width), [*keys, "_cell"], hot=hot)
    inner = (F.col("_cell") > cell(low)) & (F.col("_cell") < cell(high))
    within = F.filter("_rows", lambda r: r["_at"].between(F.col(low), F.col(high)))
    sliced = joined.withColumn("_row", F.explode(F.when(inner, F.col("_rows")).otherwise(within)))
    rest = [F.col("_row")[c].alias(c) for c in master.columns if c not in keys]
    return sliced.select(*ranges.columns, *rest)
