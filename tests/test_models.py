"""Model invariants and checks against independent computations."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import rows
from roadlens.catalog.fixtures import Tables
from roadlens.catalog.registry import ORACLE, QUERIES
from roadlens.catalog.job_queries import RISK_ATTRIBUTES, feature_rows
from roadlens.models import features as X
from roadlens.models import learners as L
from roadlens.models import metrics as E
from roadlens.operators import aggregates as A
from roadlens.operators import joins as J
from roadlens.plans import crash_models, risk, volume
from roadlens.session import materialize

FOLDER = os.environ.get("MODEL_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, FOLDER)


@pytest.fixture(scope="module")
def table(tables):
    return materialize(
        risk.risk_table(tables["fx_event_rows"], tables["fx_crashes"], RISK_ATTRIBUTES))


@pytest.fixture(scope="module")
def sample(table):
    return materialize(risk.model_sample(table, 4))


def test_sample_has_no_missing_features_and_right_sizes(sample):
    numeric = [f for f in (*risk.RATIOS, *risk.GEOMETRY, *risk.ROAD, *risk.BASIC)]
    assert A.null_profile(sample, numeric).where("missing > 0").count() == 0
    counts = {r["crash"]: r["count"] for r in sample.groupBy("crash").count().collect()}
    assert counts[0.0] == 4 * counts[1.0]


def test_nested_samples_equal_direct_ones(table):
    specs = [risk.ModelSpec(str(r), "decision_tree", risk.BASIC, ratio=r) for r in (1, 4, 10)]
    for ratio, nested in risk.samples_for(table, specs, "arc").items():
        direct = risk.model_sample(table, ratio)
        columns = ["_key", risk.CRASH, risk.LABEL, "split"]
        assert rows(nested, *columns) == rows(direct, *columns)


def test_slot_names_cover_the_vector(sample):
    assembled = X.assemble_features(sample, risk.FULL)
    names = X.slot_names(assembled)
    assert len(names) == len(set(names)) == assembled.first()["features"].size
    assert names[:6] == list(risk.RATIOS) and names[-2:] == list(risk.ROAD)


def test_forest_invariants(spark, sample):
    spec = risk.ModelSpec("m", "random_forest", risk.FULL)
    model, scored, names = risk.fit_spec(spec, sample)
    importance = E.feature_importance(spark, model.featureImportances, names).collect()
    values = [r["importance"] for r in importance]
    assert values == sorted(values, reverse=True)
    assert min(values) >= 0 and sum(values) == pytest.approx(1)
    bounds = scored.agg(F.min(risk.LABEL), F.max(risk.LABEL), F.min("prediction"),
                        F.max("prediction")).first()
    assert bounds[0] <= bounds[2] and bounds[3] <= bounds[1]
    train = scored.where("split = 'train'")
    spread = train.agg(F.var_pop(risk.LABEL)).first()[0]
    first = E.metrics_by_split(scored, risk.LABEL).orderBy("split").collect()
    assert first[1]["mse"] <= spread
    _, again, _ = risk.fit_spec(spec, sample)
    assert E.metrics_by_split(again, risk.LABEL).orderBy("split").collect() == first


def test_metrics_equal_the_evaluator(sample):
    scored = sample.select(risk.LABEL, (F.col("slope") / 100).alias("prediction"))
    got = E.regression_metrics(scored, risk.LABEL).first()
    evaluator = RegressionEvaluator(labelCol=risk.LABEL)
    for name in E.METRICS:
        expected = evaluator.evaluate(scored, {evaluator.metricName: name})
        assert got[name] == pytest.approx(expected, rel=1e-9)


def test_cross_validation_is_repeatable(sample):
    data = X.assemble_features(sample, risk.BASIC)
    grid = {"maxDepth": [2, 4]}
    scores = [
        L.grid_scores(L.cross_validate(d, L.tree(risk.LABEL), grid, risk.LABEL, ["_key"], 3))
        for d in (data, data.repartition(5))
    ]
    assert [p for p, _ in scores[0]] == [{"maxDepth": 2}, {"maxDepth": 4}]
    assert [s for _, s in scores[0]] == pytest.approx([s for _, s in scores[1]], rel=0.05)
    assert all(s > 0 for _, s in scores[0])


def test_grid_names_reach_the_estimator(sample):
    data = X.assemble_features(sample, risk.BASIC)
    model = L.cross_validate(data, L.forest(risk.LABEL, 3), {"numTrees": [2]}, risk.LABEL,
                             ["_key"], 2)
    assert model.bestModel.getNumTrees == 2


def test_chi_square_picks_the_same_slots_as_numpy(sample):
    assembled = X.assemble_features(sample, risk.ENCODED)
    _, chosen = X.chi_square_select(assembled, "features", risk.CRASH, 5)
    data = assembled.select("features", risk.CRASH).collect()
    matrix = np.array([r["features"].toArray() for r in data])
    label = np.array([r[risk.CRASH] for r in data])
    names = X.slot_names(assembled)

    def statistic(column):
        total = 0.0
        for value in np.unique(column):
            for cls in np.unique(label):
                seen = np.sum((column == value) & (label == cls))
                expected = np.sum(column == value) * np.sum(label == cls) / len(label)
                total += (seen - expected) ** 2 / expected
        return total

    scores = {n: statistic(matrix[:, i]) for i, n in enumerate(names)}
    weakest = min(scores[n] for n in chosen)
    others = [s for n, s in scores.items() if n not in chosen]
    assert len(chosen) == 5 and weakest >= max(others) - 1e-9


def test_branch_model_uses_numeric_and_five_selected_slots(sample):
    spec = risk.ModelSpec("m", "branch_forest", (*risk.FULL, risk.CRASH))
    model, scored, names = risk.fit_spec(spec, sample)
    assert model.numFeatures == 11 + 5 == len(names)
    assert {"slope", "tri", "road_lanes"} <= set(names) and "speed_limit" not in names


def test_weighted_glms_equal_the_event_level_fits(spark, tables):
    events, crashes = tables["fx_event_rows"], tables["fx_crashes"]
    categories = ("weather", "event_type", "road_cycle")
    report = {
        (r["model"], r["name"]): (r["value"], r["std_error"])
        for r in crash_models.crash_count_glm(events, crashes, categories).collect()
    }
    joined = crash_models.event_crash_counts(events.select("arc", *categories), crashes)
    labelled = joined.withColumn("crash", F.expr("CAST(count > 0 AS INT)"))
    indexed = X.indexer(categories).fit(labelled).transform(labelled)
    vectors = X.assembler([c + X.INDEX for c in categories]).transform(indexed)
    assert joined.count() == events.count()
    for title, learner in (("count", L.poisson("count")), ("crash", L.binomial("crash"))):
        plain = learner.setTol(1e-9).fit(vectors)
        names = [c + X.INDEX for c in categories] + ["intercept"]
        errors = E.standard_errors(plain, 4)
        for name, value, error in zip(names, [*plain.coefficients, plain.intercept], errors):
            assert report[(title, name)][0] == pytest.approx(value, abs=1e-5), (title, name)
            assert report[(title, name)][1] == pytest.approx(error, rel=1e-3), (title, name)
        for name, value in E.glm_statistics(plain).items():
            assert report[(title, name)][0] == pytest.approx(value, rel=1e-6), (title, name)


def test_impute_target_keeps_known_and_predicts_the_rest(tables):
    features = materialize(feature_rows(tables))
    done = volume.impute_target(features)
    assert done.count() == features.count()
    assert done.where("aadt IS NULL OR isnan(aadt)").count() == 0
    known = features.where("aadt IS NOT NULL AND NOT isnan(aadt)").select("arc", "aadt")
    kept = done.where("NOT is_predicted").select("arc", "aadt")
    assert rows(known) == rows(kept)
    low, high = known.agg(F.min("aadt"), F.max("aadt")).first()
    assert done.where((F.col("aadt") < low) | (F.col("aadt") > high)).count() == 0
    off = F.abs(F.col("crashes_aadt") - F.col("crashes_count") / F.col("aadt")) > 1e-12
    assert done.where(off).count() == 0


def test_predict_rate_with_zero_volume(spark, tables):
    features = feature_rows(tables).withColumn(
        "aadt", F.when(F.col("arc") % 10 == 1, 0.0).otherwise(F.col("aadt")))
    done = volume.predict_rate(features)
    assert done.where("crashes_aadt IS NULL").count() == 0
    assert done.where("aadt = 0 AND NOT is_predicted").count() == 0


def test_fitted_target_reports(tables):
    fitted = volume.fit_target(
        feature_rows(tables), F.col("aadt"), "aadt", volume.VOLUME_FEATURES)
    metrics = fitted.metrics().first()
    assert metrics["r2"] > 0 and metrics["rmse"] ** 2 == pytest.approx(metrics["mse"])
    names = {r["feature"] for r in fitted.importance().collect()}
    assert names == set(volume.VOLUME_FEATURES)


def test_count_regression_equals_least_squares(spark, tables):
    events, crashes = tables["fx_event_rows"], tables["fx_crashes"]
    got = {r["name"]: r["value"] for r in crash_models.crash_count_regression(
        events, crashes, ["sample_speed", "slope"], ["tunnel"], ["trip_id", "arc"]).collect()}
    assert set(got) == {"sample_speed", "slope", "tunnel", "intercept", "rmse", "mse", "mae", "r2"}
    from roadlens.operators.sampling import split_train_test
    counted = J.key_counts(crashes, "arc", "n")
    train, _ = split_train_test(events.where("slope IS NOT NULL"), ["trip_id", "arc"], 80, 123)
    data = train.join(counted, "arc", "left").na.fill(0, ["n"]).select(
        "sample_speed", "slope", F.col("tunnel").cast("double").alias("tunnel"), "n").toPandas()
    design = np.column_stack([data[["sample_speed", "slope", "tunnel"]], np.ones(len(data))])
    expected = np.linalg.lstsq(design, data["n"], rcond=None)[0]
    found = [got[n] for n in ("sample_speed", "slope", "tunnel", "intercept")]
    assert found == pytest.approx(list(expected), abs=1e-8)


def test_corr_vector_equals_pairs(tables):
    columns = ["arc_length", "curve_max_angle", "seq"]
    a = {(r["a"], r["b"]): r["r"] for r in A.corr_vector(tables["fx_arcs"], columns).collect()}
    b = {(r["a"], r["b"]): r["r"] for r in A.corr_matrix(tables["fx_arcs"], columns).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"model_comparison"}))
def test_queries_without_sql_run(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_model_comparison_has_every_model_and_split(spark, table):
    specs = risk.model_specs(  # small grids; the registered query has the full ones
        {"maxDepth": [5, 10], "maxBins": [20, 40]}, {"numTrees": [5, 10], "maxDepth": [5, 10]}, 3)
    got = risk.model_comparison(table, specs).collect()
    assert len(got) == 2 * len(specs) == 24
    assert {r["model"] for r in got if r["leaky"]} == {"model_7", "model_8", "model_9", "model_10"}
    sizes = {}
    for r in got:
        sizes.setdefault(r["ratio"], set()).add((r["split"], r["n_rows"]))
        assert r["rmse"] >= r["mae"] >= 0
    assert all(len(v) == 2 for v in sizes.values())


def test_default_grids_are_the_full_ones():
    by_name = {s.name: s for s in risk.model_specs()}
    assert by_name["model_1_cv"].grid == {"maxDepth": [5, 10, 15], "maxBins": [20, 40, 60]}
    assert by_name["model_8"].grid == {"numTrees": [5, 10, 20], "maxDepth": [5, 10, 15]}
    assert by_name["model_8"].folds == 5


def test_slices_tell_names_apart_that_begin_alike(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, "a"), (4.0, 5.0, 6.0, "b")],
                               "speed double, speed_limit double, crash_count double, crash string")
    encoded = X.fit_encoding(df, ["crash"]).transform(df)
    inputs = ["speed", "speed_limit", "crash_encoded", "crash_count"]
    built = X.assemble_features(encoded, inputs, "raw")

    def sliced(*groups):
        rows_ = X.vector_slice(built, groups, inputs, "raw", "out").orderBy("speed").collect()
        return [list(r["out"].toArray()) for r in rows_]

    assert sliced("speed") == [[1.0], [4.0]]
    assert sliced("speed_limit", "crash_count") == [[2.0, 3.0], [5.0, 6.0]]
    assert sliced("crash_encoded") == [[1.0, 0.0], [0.0, 1.0]]
