"""One fit for several depths against a fit for each."""

from __future__ import annotations

import random

import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from roadlens.functions.columns import hash_number
from roadlens.models import learners as L

COLUMNS = [f"x{i}" for i in range(7)]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        x = [rng.random() for _ in COLUMNS[:5]] + [float(i % 4), 1.0]
        rows.append((str(i), *x, x[0] * x[1] + (x[5] == 2.0) * x[2] + rng.gauss(0, 0.2)))
    df = spark.createDataFrame(rows, ["_key", *COLUMNS, "y"]).repartition(3, "_key")
    return VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(df).cache()


def plain(estimator):
    """Spark's own learner with the same parameters."""
    kind = RandomForestRegressor if estimator.hasParam("numTrees") else DecisionTreeRegressor
    return kind(**{p.name: v for p, v in estimator.extractParamMap().items()})


def maps(estimator, **grid):
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    return builder.build()


def counted(estimator, monkeypatch):
    fits, fit = [], type(estimator)._fit
    monkeypatch.setattr(type(estimator), "_fit", lambda self, df: (fits.append(self.getMaxDepth()), fit(self, df))[1])
    return fits


CASES = [(lambda: L.tree("y"), {"maxDepth": [0, 2, 5, 9], "maxBins": [4, 32]}),
         (lambda: L.forest("y", 3), {"numTrees": [1, 4], "maxDepth": [9, 3, 6]})]


@pytest.mark.parametrize(("learner", "grid"), CASES, ids=["tree", "forest"])
def test_every_depth_is_the_model_of_its_own_fit(data, monkeypatch, learner, grid):
    estimator = learner()
    fits, points = counted(estimator, monkeypatch), maps(estimator, **grid)
    models = dict(estimator.fitMultiple(data, points))
    assert fits == [9, 9] and sorted(models) == list(range(len(points)))
    for i, point in enumerate(points):
        alone = plain(estimator.copy(point)).fit(data)
        assert models[i].getMaxDepth() == point[estimator.maxDepth]
        assert models[i].toDebugString.split("\n")[1:] == alone.toDebugString.split("\n")[1:]
        assert models[i].transform(data).select("prediction").collect() == alone.transform(data).select("prediction").collect()


def test_search_scores_and_picks_as_with_a_fit_each(data, monkeypatch):
    estimator, grid = L.forest("y", 3), {"numTrees": [2, 4], "maxDepth": [2, 4, 8]}
    folded = data.withColumn("_fold", F.pmod(hash_number(L.SEED, "_key"), F.lit(3)).cast("int"))
    own = plain(estimator)
    expected = CrossValidator(estimator=own, estimatorParamMaps=maps(own, **grid), numFolds=3, foldCol="_fold",
                              evaluator=RegressionEvaluator(labelCol="y")).fit(folded)
    fits = counted(estimator, monkeypatch)
    got = L.cross_validate(data, estimator, grid, "y", ["_key"], 3, parallelism=2)
    assert got.avgMetrics == pytest.approx(expected.avgMetrics, rel=1e-12)
    assert got.bestModel.toDebugString.split("\n")[1:] == expected.bestModel.toDebugString.split("\n")[1:]
    assert len(fits) == 2 * 3 + 1  # 6 points, 3 folds: two fits a fold, and the best model


def test_levels_beyond_the_memory_of_a_pass_are_fitted_each(data, monkeypatch):
    """Then a deeper forest draws its features in another order."""
    estimator = L.forest("y", 12).setMaxMemoryInMB(1)
    points = maps(estimator, maxDepth=[2, 7, 8])
    fits = counted(estimator, monkeypatch)
    models = dict(estimator.fitMultiple(data, points))
    assert sorted(fits) == [7, 8]
    for i, point in enumerate(points):
        alone = plain(estimator.copy(point)).fit(data)
        assert models[i].toDebugString.split("\n")[1:] == alone.toDebugString.split("\n")[1:]


def test_a_failed_fit_is_told_to_all(data):
    estimator = L.tree("y")
    models = estimator.fitMultiple(data.withColumn("y", F.lit("a")), maps(estimator, maxDepth=[2, 3]))
    for _ in range(2):
        with pytest.raises(Exception, match="y"):
            next(models)
