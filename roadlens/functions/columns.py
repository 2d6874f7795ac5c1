"""Column expressions used by the operators. All are JVM-side built-ins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """``numerator / denominator`` as double; null for a zero or null denominator."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def row_sum(columns: Sequence[Column | str]) -> Column:
    """Sum of several columns of one row."""
    return reduce(add, [_col(c) for c in columns])


def near_any(
    columns: Sequence[Column | str], max_distance: float = 300, absent: float = -1
) -> Column:
    """1 when any distance lies strictly between ``absent`` and ``max_distance``,
    else 0. A null distance is not near."""
    tests = [(_col(c) < F.lit(max_distance)) & (_col(c) > F.lit(absent)) for c in columns]
    return F.when(reduce(or_, tests), 1).otherwise(0)


def bool_to_double(column: Column | str) -> Column:
    """True gives 1.0; false and null give 0.0."""
    return F.when(_col(column), 1.0).otherwise(0.0)


def null_to(column: Column | str, value) -> Column:
    return F.coalesce(_col(column), F.lit(value))


def positive_flag(column: Column | str) -> Column:
    """1 for a count above zero, else 0."""
    return F.when(_col(column) > 0, 1).otherwise(0)


def concat_key(*columns: Column | str, sep: str = "_") -> Column:
    """Composite text key; null when any part is null."""
    parts: list[Column] = []
    for c in columns:
        if parts:
            parts.append(F.lit(sep))
        parts.append(_col(c).cast("string"))
    return F.concat(*parts)


def not_nan(column: Column | str) -> Column:
    """The value, with NaN turned into null."""
    c = _col(column)
    return F.when(~F.isnan(c), c)


def is_known(column: Column | str) -> Column:
    """True for a value that is neither null nor NaN."""
    c = _col(column)
    return c.isNotNull() & ~F.isnan(c)


def pair_correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation over the rows where both values are known; null when
    either side does not vary."""
    left, right = _col(a).cast("double"), _col(b).cast("double")
    both = is_known(left) & is_known(right)
    x, y = F.when(both, left), F.when(both, right)
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))


def hash_number(seed: int, *columns: Column | str) -> Column:
    """Deterministic 32-bit number from the md5 of ``seed:key``; never null, as a null
    key counts as empty text."""
    parts = [F.coalesce(_col(c).cast("string"), F.lit("")) for c in columns]
    text = F.concat(F.lit(f"{seed}:"), F.concat_ws("|", *parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_percent(seed: int, *columns: Column | str) -> Column:
    """Deterministic bucket 0..99 of a row, independent of partitioning."""
    return F.pmod(hash_number(seed, *columns), F.lit(100))
