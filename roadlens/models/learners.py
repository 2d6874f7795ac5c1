"""Estimators on Spark ML. Each fit is distributed; only model parameters reach the
driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import ChiSqSelector
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.functions.columns import hash_number
from roadlens.models.depths import ForestRegressor, TreeRegressor
from roadlens.models.features import assembler

# fixed values of the parameter grids and learners
SEED = 42
TREE_GRID = {"maxDepth": [5, 10, 15], "maxBins": [20, 40, 60]}
FOREST_GRID = {"numTrees": [5, 10, 20], "maxDepth": [5, 10, 15]}
FOLDS = 5


def linear(label: str, features: str = "features") -> LinearRegression:
    return LinearRegression(featuresCol=features, labelCol=label)


def poisson(label: str, weight: str | None = None) -> GeneralizedLinearRegression:
    return _glm("poisson", "log", label, weight)


def binomial(label: str, weight: str | None = None) -> GeneralizedLinearRegression:
    return _glm("binomial", "logit", label, weight)


def _glm(family: str, link: str, label: str, weight: str | None) -> GeneralizedLinearRegression:
    glm = GeneralizedLinearRegression(family=family, link=link, labelCol=label)
    return glm if weight is None else glm.setWeightCol(weight)


def forest(label: str, trees: int, features: str = "features") -> ForestRegressor:
    return ForestRegressor(
        featuresCol=features, labelCol=label, numTrees=trees, seed=SEED
    )


def tree(label: str, features: str = "features") -> TreeRegressor:
    return TreeRegressor(featuresCol=features, labelCol=label, seed=SEED)


def boosted(label: str, features: str = "features") -> GBTRegressor:
    return GBTRegressor(
        featuresCol=features, labelCol=label, maxDepth=5, maxBins=32, maxIter=20, seed=SEED
    )


def cross_validate(
    df: DataFrame,
    estimator: Estimator,
    grid: Mapping[str, Sequence],
    label: str,
    keys: Sequence[str],
    folds: int = FOLDS,
    metric: str = "rmse",
    parallelism: int = 4,
) -> CrossValidatorModel:
    """Grid search. A row's fold comes from the hash of its keys, so the folds do not
    depend on partitioning. Of trees and forests, a fold's grid points that differ in depth
    alone share one fit (``DepthsInOneFit``). Vectors and folds are made once, and only the
    columns that the estimator reads are kept for the folds."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    read = {v for p, v in estimator.extractParamMap().items() if p.name.endswith("Col")} | {label}
    columns = [c for c in df.columns if c in read or not estimator.hasParam("featuresCol")]
    fold = F.pmod(hash_number(SEED, *keys), F.lit(folds)).cast("int").alias("_fold")
    folded = df.select(*columns, fold).cache()
    try:
        return CrossValidator(
            estimator=estimator,
            estimatorParamMaps=builder.build(),
            evaluator=RegressionEvaluator(labelCol=label, metricName=metric),
            numFolds=folds,
            foldCol="_fold",
            parallelism=parallelism,
            seed=SEED,
        ).fit(folded)
    finally:
        folded.unpersist()


def grid_scores(model: CrossValidatorModel) -> list[tuple[dict, float]]:
    """(parameters, mean metric) per grid point."""
    return [
        ({p.name: v for p, v in params.items()}, float(score))
        for params, score in zip(model.getEstimatorParamMaps(), model.avgMetrics)
    ]


class ZeroInflatedPair:
    """A binomial model of whether an arc has crashes and a Poisson model of how many."""

    def __init__(self, crash: Model, count: Model):
        self.crash, self.count = crash, count

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds p_crash, lambda and their product, the expected count."""
        kept = [F.col(c) for c in df.columns]
        scored = self.crash.transform(df).select(*kept, F.col("prediction").alias("p_crash"))
        scored = self.count.transform(scored).select(
            *kept, "p_crash", F.col("prediction").alias("lambda")
        )
        return scored.withColumn("expected", F.col("p_crash") * F.col("lambda"))


def zero_inflated_pair(df: DataFrame, count: str, crash: str) -> ZeroInflatedPair:
    """Fit both models on the same assembled rows, those without crashes included."""
    return ZeroInflatedPair(binomial(crash).fit(df), poisson(count).fit(df))


def branch_model(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    label: str,
    class_label: str,
    top: int = 5,
    trees: int = 5,
) -> PipelineModel:
    """Forest over the numeric columns and the ``top`` categorical slots that a chi-square
    test picks against ``class_label``."""
    chosen = ChiSqSelector(
        numTopFeatures=top, featuresCol="categories", outputCol="chosen", labelCol=class_label)
    return Pipeline(stages=[
        assembler(numeric, "numbers", "keep"), assembler(categorical, "categories", "keep"),
        chosen, assembler(["numbers", "chosen"], "features", "keep"), forest(label, trees),
    ]).fit(df)
