"""Least squares from cross products."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.models.least_squares import CrossProducts, cross_products, solve


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)) * [1.0, 1e-3, 5e4] + [1e6, 0.0, -2e5]
    return np.column_stack([x, x @ [2.0, -7.0, 1e-4] + rng.normal(size=400) + 5])


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [(*map(float, r), "ab"[i % 2]) for i, r in enumerate(data)]
    rows += [(None, 1.0, 1.0, 1.0, "a"), (1.0, float("nan"), 1.0, 1.0, "b"), (1.0, 1.0, 1.0, None, "a")]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, part string").repartition(5)


def test_large_means_do_not_cost_digits(frame, data):
    fit = solve(cross_products(frame, ["a", "b", "c", "y"])[()], "y")
    centred = data - data.mean(0)
    expected = np.linalg.lstsq(centred[:, :3], centred[:, 3], rcond=None)[0]
    assert fit.n == 400 and list(fit.coefficients) == pytest.approx(list(expected), rel=1e-8)
    assert fit.intercept == pytest.approx(data.mean(0)[3] - expected @ data.mean(0)[:3], rel=1e-6)
    row = frame.where("a > 100").select(fit.prediction().alias("p"), "a", "b", "c").first()
    assert row["p"] == pytest.approx(fit.intercept + fit.coefficients @ [row["a"], row["b"], row["c"]])
    assert [n for n, _ in fit.values()] == ["a", "b", "c", "intercept"]


def test_parts_merge(frame):
    names = ["y", "c", "a"]
    whole, parts = cross_products(frame, names)[()], cross_products(frame, names, ["part"])
    merged = parts[("a",)] + parts[("b",)]
    assert merged.n == whole.n and np.allclose(merged.means, whole.means, rtol=1e-12)
    assert np.allclose(merged.products, whole.products, rtol=1e-9)
    nothing = CrossProducts(tuple(names), 0, np.zeros(3), np.zeros((3, 3)))
    assert (merged + nothing) is merged and (nothing + merged) is merged
    with pytest.raises(ValueError, match="different columns"):
        whole + CrossProducts(("y",), 0, np.zeros(1), np.zeros((1, 1)))


def test_constant_and_dependent_columns(spark):
    df = spark.range(50).select(
        (F.col("id") * 1.0).alias("x"), (F.col("id") * 2.0).alias("twice"), F.lit(0.1).alias("same"),
        (F.col("id") * 10.0 + 3).alias("y"))
    fit = solve(cross_products(df, ["x", "twice", "same", "y"])[()], "y")
    assert fit.coefficients[2] == 0
    assert fit.coefficients[0] + 2 * fit.coefficients[1] == pytest.approx(10)
    assert fit.intercept == pytest.approx(3)


def test_no_rows(spark):
    empty = spark.createDataFrame([(None, 1.0)], "x double, y double")
    with pytest.raises(ValueError, match="no complete rows"):
        solve(cross_products(empty, ["x", "y"])[()], "y")
    assert cross_products(empty, ["x", "y"], ["x"]) == {}
