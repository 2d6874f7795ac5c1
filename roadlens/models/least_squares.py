"""Least squares from sufficient statistics.

Rows enter a fit through their number, means and cross products about the means only, which
one aggregate gives for every group at once. They merge, so later parts of a table can be added
to statistics kept from earlier ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement
from operator import add, and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.functions.columns import is_known

HEAD_ROWS = 1000


@dataclass(frozen=True)
class CrossProducts:
    """Number of rows, means and centred cross products of some columns."""

    names: tuple[str, ...]
    n: int
    means: np.ndarray
    products: np.ndarray

    def __add__(self, other: CrossProducts) -> CrossProducts:
        """Statistics of both sets of rows together."""
        if self.names != other.names:
            raise ValueError("the statistics are of different columns")
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        apart = other.means - self.means
        return CrossProducts(
            self.names, n, self.means + apart * (other.n / n),
            self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n))


def head_means(df: DataFrame, columns: Sequence[str], rows: int = HEAD_ROWS) -> dict[str, float]:
    """Means of the first complete rows that come, 0 where there are none: somewhere in the
    range of the data, which is all that ``cross_products`` needs."""
    found = _complete(df.select(*columns), columns).limit(rows).agg(*[F.avg(c).alias(c) for c in columns]).first()
    return {c: found[c] or 0.0 for c in columns}


def _complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(reduce(and_, [is_known(F.col(c).cast("double")) for c in columns]))


def cross_products(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), near: Mapping[str, float] | None = None
) -> dict[tuple, CrossProducts]:
    """The statistics of every group, from one aggregate of plain sums; rows with a missing
    value in any of the columns are left out. The number of groups is the caller's to bound.

    Values are taken from a point ``near`` the data (``head_means`` by default), as sums of
    squares far from their mean lose digits."""
    names = tuple(columns)
    near = head_means(df, names) if near is None else near
    points = [float(near.get(c, 0.0)) for c in names]
    apart = [F.col(c).cast("double") - F.lit(x) for c, x in zip(names, points, strict=True)]
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    found = _complete(df, names).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(x).alias(f"_s{i}") for i, x in enumerate(apart)],
        *[F.sum(apart[i] * apart[j]).alias(f"_p{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for row in found:
        n = row["_n"]
        means, products = np.zeros(len(names)), np.zeros((len(names), len(names)))
        if n:
            means = np.array([row[f"_s{i}"] for i in range(len(names))]) / n
            for i, j in pairs:
                products[i, j] = products[j, i] = row[f"_p{i}_{j}"] - n * means[i] * means[j]
            means = means + points
        out[tuple(row[b] for b in by)] = CrossProducts(names, n, means, products)
    return out


@dataclass(frozen=True)
class LinearFit:
    """An ordinary least squares fit of one column by others."""

    names: tuple[str, ...]
    coefficients: np.ndarray
    intercept: float
    n: int

    def prediction(self) -> Column:
        terms = [F.lit(float(b)) * F.col(c).cast("double") for c, b in zip(self.names, self.coefficients, strict=True)]
        return reduce(add, terms, F.lit(float(self.intercept)))

    def values(self) -> list[tuple[str, float]]:
        return [*zip(self.names, map(float, self.coefficients), strict=True), ("intercept", float(self.intercept))]


def solve(statistics: CrossProducts, label: str) -> LinearFit:
    """The fit of ``label`` by the other columns.

    The normal equations are solved in standard units; a column that does not vary gets 0,
    and of columns that depend on each other the smallest coefficients are taken."""
    if not statistics.n:
        raise ValueError("no complete rows to fit")
    at = statistics.names.index(label)
    others = [i for i in range(len(statistics.names)) if i != at]
    inner = statistics.products[np.ix_(others, others)]
    outer = statistics.products[others, at]
    scale = np.sqrt(np.diag(inner))
    # rounding leaves a constant column a variance of this order
    varies = scale > 1e-12 * np.sqrt(statistics.n) * np.maximum(1.0, np.abs(statistics.means[others]))
    coefficients = np.zeros(len(others))
    if varies.any():
        scale = scale[varies]
        unit = inner[np.ix_(varies, varies)] / np.outer(scale, scale)
        coefficients[varies] = np.linalg.lstsq(unit, outer[varies] / scale, rcond=1e-12)[0] / scale
    intercept = statistics.means[at] - coefficients @ statistics.means[others]
    return LinearFit(tuple(statistics.names[i] for i in others), coefficients, float(intercept), statistics.n)
