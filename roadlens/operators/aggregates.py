"""Grouped counts, statistics, correlations and confusion tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.functions.columns import not_nan, pair_correlation
from roadlens.operators.quantiles import approx_quantiles


def _rows() -> Column:
    return F.count(F.lit(1))


def group_count(df: DataFrame, *keys: str, name: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(_rows().alias(name))


def group_count_distinct(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """Exact distinct values per key. Spark first aggregates by (key, value), so a hot
    key is split over its values."""
    return df.groupBy(key).agg(F.countDistinct(column).alias(name))


def pivot_count(
    df: DataFrame,
    key: str,
    category: str,
    values: Sequence[str] | None = None,
    null_name: str = "unknown",
    other_name: str = "other",
) -> DataFrame:
    """One count column per category value, 0 where there is none; null has its own
    column, apart from a value of that text. With ``values`` given no extra job looks for
    them, and ``other_name`` counts the rest; without, every value that occurs gets one."""
    value = F.col(category)
    if values is None:
        pivoted = df.where(value.isNotNull()).groupBy(key).pivot(category).agg(_rows())
        nulls = df.groupBy(key).agg(F.count_if(value.isNull()).alias("_nulls"))
        same = nulls[key].eqNullSafe(pivoted[key])
        joined = nulls.join(pivoted, same, "left").select(
            nulls[key], *[pivoted[c] for c in pivoted.columns if c != key],
            F.col("_nulls").alias(null_name if null_name not in pivoted.columns else f"{null_name}_null"))
        return joined.na.fill(0, [c for c in joined.columns if c != key])
    return df.groupBy(key).agg(
        *[F.count_if(value == v).alias(v) for v in values],
        F.count_if(~value.isin(*values)).alias(other_name),
        F.count_if(value.isNull()).alias(null_name),
    )


def global_mean_max(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.avg(column).alias("mean_value"), F.max(column).alias("max_value"))


def multi_column_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in columns])


def mean_position(df: DataFrame, lat: str, lng: str) -> DataFrame:
    return df.agg(F.avg(lat).alias("mean_lat"), F.avg(lng).alias("mean_lng"))


def conditional_count(df: DataFrame, **conditions: Column) -> DataFrame:
    """Row count and the count of each named condition in one pass."""
    return df.agg(_rows().alias("rows"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def to_rows(df: DataFrame, columns: Sequence[str], name: str, value: str) -> DataFrame:
    """A one-row frame as one row per column."""
    return df.unpivot([], list(columns), name, value)


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column and in total, from one pass over the data."""
    names = list(columns or df.columns)
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    total = F.lit(0).cast("bigint")
    for c in names:
        total = total + F.col(f"`{c}`")
    return to_rows(one.withColumn("_total", total), [*names, "_total"], "column_name", "missing")


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """(column_name, probability, value) from bounded sketches, one pass."""
    one = approx_quantiles(df, columns, probabilities)
    rows = to_rows(one, columns, "column_name", "_values")
    pairs = F.arrays_zip(
        F.array(*[F.lit(float(p)) for p in probabilities]).alias("probability"),
        F.col("_values").alias("value"),
    )
    return rows.select("column_name", F.inline(pairs))


def corr_pair(df: DataFrame, a: str, b: str, name: str = "r") -> DataFrame:
    return df.agg(pair_correlation(a, b).alias(name))


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for every pair, each over the rows where both are known; one pass."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[pair_correlation(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("r"))
          for i, (a, b) in enumerate(pairs)]
    )
    return one.select(F.inline(rows))


def corr_vector(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """(a, b, r) for the upper triangle, over rows complete in all columns."""
    complete = df.select(*columns).na.drop()
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(complete)
    matrix = Correlation.corr(vectors, "_v", method).first()[0].toArray()
    rows = [
        (columns[i], columns[j], float(matrix[i, j]))
        for i, j in combinations(range(len(columns)), 2)
    ]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def summary_stats(
    df: DataFrame, columns: Sequence[str], quartiles: bool = False
) -> DataFrame:
    """(column_name, n, mean, stddev, min, max), and approximate quartiles on request."""
    stats = []
    for c in columns:
        value = not_nan(F.col(c).cast("double"))
        fields = [
            F.lit(c).alias("column_name"), F.count(value).alias("n"), F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("stddev"), F.min(value).alias("min"),
            F.max(value).alias("max"),
        ]
        if quartiles:
            for name, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75)):
                fields.append(F.percentile_approx(value, p, 10000).alias(name))
        stats.append(F.struct(*fields))
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def group_min_max(
    df: DataFrame, keys: Sequence[str], column: str, low: str = "lo", high: str = "hi"
) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(column).alias(low), F.max(column).alias(high))


def group_sums(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Row count and null-skipping sums per group; a sum of nothing is 0."""
    return df.groupBy(*keys).agg(
        _rows().alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns]
    )


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def distinct_sorted(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct().orderBy(*columns)


def range_length_sum(
    df: DataFrame, keys: Sequence[str], low: str = "lo", high: str = "hi", name: str = "length"
) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col(high) - F.col(low) + 1).alias(name))


def confusion_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Long form: (actual, predicted, count)."""
    return group_count(df, actual, predicted)


def confusion_matrix(
    df: DataFrame, actual: str, predicted: str, classes: Sequence[object]
) -> DataFrame:
    """One row per actual class, one ``predicted_<class>`` column per class."""
    return df.groupBy(actual).agg(
        *[F.count_if(F.col(predicted) == F.lit(c)).alias(f"predicted_{c}") for c in classes]
    )
