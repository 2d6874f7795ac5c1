"""Projections, casts, null handling and filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.functions.columns import not_nan, row_sum, safe_ratio
from roadlens.operators.quantiles import approx_median, exact_quantiles

FLOATING = ("float", "double")


def project_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*names)


def project_expr(df: DataFrame, *expressions: str) -> DataFrame:
    return df.selectExpr(*expressions)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename; names match without regard to case, as Spark resolves them."""
    return df.withColumnRenamed(old, new)


def drop_columns(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.drop(*columns)


def literal_columns(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({name: F.lit(v) for name, v in values.items()})


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast named columns in place; a value that does not fit becomes null."""
    return df.withColumns({name: F.col(name).try_cast(t) for name, t in types.items()})


# fixed values: the types that learners are given as double
LEARNER_TYPES = ("int", "bigint", "smallint", "float")


def cast_by_type(
    df: DataFrame,
    source_types: Iterable[str] = LEARNER_TYPES,
    target: str = "double",
) -> DataFrame:
    """Cast every column of the given types in one projection."""
    wanted = set(source_types)
    return df.select(
        [F.col(n).cast(target).alias(n) if t in wanted else F.col(n) for n, t in df.dtypes]
    )


def fill_constants(
    df: DataFrame, value, subset: Sequence[str] | None = None
) -> DataFrame:
    """Fill nulls by a column-to-value map, a subset, or over the whole frame."""
    return df.na.fill(value) if subset is None else df.na.fill(value, subset=list(subset))


def impute_median(df: DataFrame, columns: Sequence[str], exact: bool = False) -> DataFrame:
    """Fill nulls with the column's median over the same frame; a column without any
    value stays null.

    The default sketches all columns in one aggregate of fixed size, whose single row
    the driver reads. ``exact`` gives the interpolated middle value. Give a frame that
    is cheap to read twice."""
    if exact:
        medians = {c: v[0] for c, v in exact_quantiles(df, columns, [0.5]).items()}
    else:
        medians = df.agg(*[approx_median(df, c).alias(c) for c in columns]).first().asDict()
    return _fill(df, {c: F.col(c) for c in columns}, medians)


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill null and NaN with the mean of the known values of each column; one
    aggregate for all columns."""
    types = dict(df.dtypes)
    known = {c: not_nan(c) if types[c] in FLOATING else F.col(c) for c in columns}
    means = df.agg(*[F.avg(v).alias(c) for c, v in known.items()]).first().asDict()
    return _fill(df, known, means)


def _fill(df: DataFrame, known: Mapping[str, Column], values: Mapping[str, float | None]):
    return df.withColumns(
        {c: v if values[c] is None else F.coalesce(v, F.lit(values[c])) for c, v in known.items()}
    )


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=None if subset is None else list(subset))


def ratio_columns(
    df: DataFrame, columns: Sequence[str], total: str, suffix: str = "_ratio"
) -> DataFrame:
    """Each column over the total, added next to the existing ones."""
    return df.withColumns({f"{c}{suffix}": safe_ratio(c, total) for c in columns})


def add_row_sum(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    return df.withColumn(name, row_sum(columns))


def null_flags(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Every cell replaced by whether it is null."""
    return df.select([F.col(c).isNull().alias(c) for c in (columns or df.columns)])


def filter_equal(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def filter_not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def filter_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def filter_not_nan(df: DataFrame, column: str) -> DataFrame:
    """Drop NaN; nulls stay, as ``isnan(null)`` is false."""
    return df.where(~F.isnan(column))


def filter_between(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.where(F.col(column).between(low, high))


def filter_in_list(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose value is in the first column of ``values``, of any length."""
    listed = values.select(F.col(values.columns[0]).alias(column))
    return df.join(listed, column, "left_semi")
