"""Regression metrics, named coefficients and importances, GLM diagnostics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml.regression import GeneralizedLinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ("rmse", "mse", "mae", "r2")
NO_STANDARD_ERRORS = "No Std. Error"  # how Spark says that the normal equations are singular


def regression_metrics(
    df: DataFrame, label: str, prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """n_rows, rmse, mse, mae and r2 in one aggregate, per group if asked."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    known = df.where(y.isNotNull() & p.isNotNull())
    mse = F.avg((y - p) * (y - p))
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sqrt(mse).alias("rmse"),
        mse.alias("mse"),
        F.avg(F.abs(y - p)).alias("mae"),
        (F.lit(1.0) - F.try_divide(mse, F.var_pop(y))).alias("r2"),
    )


def metrics_by_split(
    df: DataFrame, label: str, prediction: str = "prediction", split: str = "split"
) -> DataFrame:
    return regression_metrics(df, label, prediction, [split])


def named_values(
    spark: SparkSession, names: Sequence[str], values: Sequence[float], name: str, value: str
) -> DataFrame:
    """One row per model parameter; a model has few of them."""
    rows = [(n, float(v)) for n, v in zip(names, values, strict=True)]
    return spark.createDataFrame(rows, f"{name} string, {value} double")


def feature_importance(
    spark: SparkSession, importances, names: Sequence[str]
) -> DataFrame:
    """(feature, importance), largest first, named by vector slot."""
    frame = named_values(spark, names, importances.toArray(), "feature", "importance")
    return frame.orderBy(F.col("importance").desc(), "feature")


def named_coefficients(
    spark: SparkSession, model, names: Sequence[str]
) -> DataFrame:
    """(name, value) of every coefficient and the intercept."""
    values = [*model.coefficients.toArray(), model.intercept]
    return named_values(spark, [*names, "intercept"], values, "name", "value")


def standard_errors(model: GeneralizedLinearRegressionModel, size: int) -> list[float | None]:
    """Standard errors in coefficient order, then the intercept's; Spark has none when
    the normal equations are singular."""
    try:
        found = [float(v) for v in model.summary.coefficientStandardErrors]
    except (PySparkException, Py4JJavaError) as error:
        if NO_STANDARD_ERRORS not in str(error):
            raise
        return [None] * size
    return found + [None] * (size - len(found))


def glm_statistics(
    model: GeneralizedLinearRegressionModel, n_rows: int | None = None
) -> dict[str, float]:
    """Deviances, degrees of freedom, AIC and BIC.

    ``n_rows`` is the number of observations behind weighted rows."""
    summary = model.summary
    rows = summary.numInstances if n_rows is None else n_rows
    rank = summary.rank
    log_likelihood = rank - summary.aic / 2
    return {
        "deviance": summary.deviance,
        "null_deviance": summary.nullDeviance,
        "explained_deviance": summary.nullDeviance - summary.deviance,
        "degrees_of_freedom": float(rows - rank),
        "log_likelihood": log_likelihood,
        "aic": 2 * rank - 2 * log_likelihood,
        "bic": rank * math.log(rows) - 2 * log_likelihood,
    }


def bernoulli_statistics(
    scored: DataFrame, rate: str, weight: str, prediction: str, rank: int
) -> dict[str, float]:
    """The statistics of ``glm_statistics`` for a 0/1 outcome given as grouped rows: the
    rate of ones and the number of observations behind it."""
    y, w, p = F.col(rate), F.col(weight), F.col(prediction)

    def terms(expected):
        """Log-likelihood of the group at an expected rate; 0 log 0 counts as 0."""
        ones = F.when(y > 0, y * F.log(expected)).otherwise(0.0)
        zeros = F.when(y < 1, (1 - y) * F.log(1 - expected)).otherwise(0.0)
        return F.sum(w * (ones + zeros))

    sums = scored.agg(
        F.sum(w).alias("n"), F.sum(w * y).alias("ones"), terms(p).alias("log_likelihood")
    ).first()
    rows, ones = sums["n"], sums["ones"]
    mean = ones / rows
    null = (ones * math.log(mean) if ones else 0.0) + (
        (rows - ones) * math.log(1 - mean) if ones < rows else 0.0
    )
    log_likelihood = sums["log_likelihood"]
    return {
        "deviance": -2 * log_likelihood,
        "null_deviance": -2 * null,
        "explained_deviance": 2 * (log_likelihood - null),
        "degrees_of_freedom": float(rows - rank),
        "log_likelihood": log_likelihood,
        "aic": 2 * rank - 2 * log_likelihood,
        "bic": rank * math.log(rows) - 2 * log_likelihood,
    }


def glm_report(
    spark: SparkSession,
    models: Mapping[str, tuple[GeneralizedLinearRegressionModel, Mapping[str, float]]],
    names: Sequence[str],
) -> DataFrame:
    """(model, name, value, std_error): coefficients, intercept and the statistics
    given with each model."""
    rows = []
    for title, (model, statistics) in models.items():
        values = [*model.coefficients.toArray(), model.intercept]
        errors = standard_errors(model, len(values))
        for name, value, error in zip([*names, "intercept"], values, errors, strict=True):
            rows.append((title, name, float(value), error))
        for name, value in statistics.items():
            rows.append((title, name, float(value), None))
    return spark.createDataFrame(
        rows, "model string, name string, value double, std_error double"
    )
