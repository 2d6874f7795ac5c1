"""Risk models 1 to 11: feature set x class ratio x algorithm."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.models.features import assemble_features, slot_names
from roadlens.models.learners import (
    FOREST_GRID, FOLDS, TREE_GRID, boosted, branch_model, cross_validate, forest, tree,
)
from roadlens.models.metrics import METRICS, feature_importance, metrics_by_split
from roadlens.operators.projection import cast_by_type, impute_mean
from roadlens.operators.sampling import limit_ratio, with_split
from roadlens.plans.arcs import EVENT_TYPES, arc_risk_rows, column_name, encode_categories
from roadlens.session import materialize

LABEL, CRASH = "crash_per_event", "crash"

# fixed values: feature groups and model list
RATIOS = tuple(f"{column_name(t)}_ratio" for t in EVENT_TYPES)
GEOMETRY = ("slope", "tri", "arc_length", "curve_max_angle")
CATEGORIES = ("interaction_poi", "circulation_poi", "road_priority")
ENCODED = tuple(f"{c}_encoded" for c in CATEGORIES)
ROAD = ("speed_limit", "road_lanes")
BASIC = ("road_priority", "tunnel", "bridge", "excessive_speeding", "phone_handling_event")
FULL = (*RATIOS, *GEOMETRY, *ENCODED, *ROAD)
NUMERIC = (*RATIOS, *GEOMETRY, *ROAD, *BASIC)
SLIM_WITHOUT = ("potential_collision_event_ratio", "speeding_event_ratio", "curve_max_angle")


@dataclass(frozen=True)
class ModelSpec:
    """One row of the model list. ``leaky`` marks models that see the crash flag."""

    name: str
    algorithm: str
    features: tuple[str, ...]
    ratio: int = 4
    trees: int = 5
    grid: Mapping[str, Sequence] = field(default_factory=dict)
    folds: int = FOLDS
    top: int = 5

    @property
    def leaky(self) -> bool:
        return CRASH in self.features


def model_specs(
    tree_grid: Mapping[str, Sequence] = TREE_GRID,
    forest_grid: Mapping[str, Sequence] = FOREST_GRID,
    folds: int = FOLDS,
) -> list[ModelSpec]:
    slim = tuple(f for f in FULL if f not in SLIM_WITHOUT)
    with_crash = (*FULL, CRASH)
    return [
        ModelSpec("model_1", "decision_tree", BASIC),
        ModelSpec("model_1_cv", "decision_tree_cv", BASIC, grid=tree_grid, folds=folds),
        ModelSpec("model_2", "random_forest", (*RATIOS, *GEOMETRY, *ENCODED)),
        ModelSpec("model_3", "random_forest", FULL),
        ModelSpec("model_4", "random_forest", FULL, ratio=1),
        ModelSpec("model_5", "random_forest", FULL, ratio=10),
        ModelSpec("model_6", "random_forest", slim),
        ModelSpec("model_7", "random_forest", with_crash),
        ModelSpec("model_8", "random_forest_cv", with_crash, grid=forest_grid, folds=folds),
        ModelSpec("model_9", "branch_forest", with_crash),
        ModelSpec("model_10", "gradient_boosting", with_crash),
        ModelSpec("model_11", "gradient_boosting", FULL),
    ]


def risk_table(
    events: DataFrame, crashes: DataFrame, attributes: Sequence[str], key: str = "arc", **options
) -> DataFrame:
    """One row per arc: typed attributes, encoded categories, event mix and labels."""
    return encode_categories(
        arc_risk_rows(events, crashes, attributes, key, **options), CATEGORIES
    )


def balanced_sample(
    df: DataFrame, label: str, ratio: int, keys: Sequence[str], seed: int = 42
) -> DataFrame:
    """All rows of class 1 and at most ``ratio`` times as many of class 0, chosen by the
    hash of their keys. Rows without a label are left out."""
    return limit_ratio(df, label, keys, ratio, seed, positives=True)


def prepared(sample: DataFrame) -> DataFrame:
    """Balanced rows ready for a learner: numbers as double, missing features filled
    with the sample's mean, train or test marked."""
    labelled = cast_by_type(sample.where(F.col(LABEL).isNotNull()))
    return with_split(impute_mean(labelled, NUMERIC), ["_key"])


def model_sample(table: DataFrame, ratio: int, key: str = "arc") -> DataFrame:
    """A balanced sample of the risk table, prepared."""
    named = table.withColumn("_key", F.col(key).cast("string"))
    return prepared(materialize(balanced_sample(named, CRASH, ratio, ["_key"])))


def fit_spec(spec: ModelSpec, sample: DataFrame) -> tuple[Model, DataFrame, list[str]]:
    """Fit one model on the training rows and score all rows of the sample."""
    if spec.algorithm == "branch_forest":
        # the numeric branch of this model has no speed limit
        categorical = [f for f in spec.features if f in (*ENCODED, CRASH)]
        numeric = [f for f in spec.features if f not in (*categorical, "speed_limit")]
        model = branch_model(
            sample.where("split = 'train'"), numeric, categorical, LABEL, CRASH,
            spec.top, spec.trees,
        )
        scored = model.transform(sample)
        names = [n.removeprefix("numbers_").removeprefix("chosen_")
                 for n in slot_names(scored)]
        return model.stages[-1], scored, names
    rows = assemble_features(sample, spec.features)
    train = rows.where("split = 'train'")
    if spec.algorithm == "decision_tree":
        model = tree(LABEL).fit(train)
    elif spec.algorithm == "random_forest":
        model = forest(LABEL, spec.trees).fit(train)
    elif spec.algorithm == "gradient_boosting":
        model = boosted(LABEL).fit(train)
    else:
        base = tree(LABEL) if spec.algorithm == "decision_tree_cv" else forest(LABEL, spec.trees)
        model = cross_validate(train, base, spec.grid, LABEL, ["_key"], spec.folds,
                               parallelism=2).bestModel
    return model, model.transform(rows), slot_names(rows)


def samples_for(table: DataFrame, specs: Sequence[ModelSpec], key: str) -> dict[int, DataFrame]:
    """One materialized sample per class ratio, shared by the models that use it.

    A smaller sample is the head of a larger one in hash order, so only the largest is
    drawn from the whole table."""
    samples, rows = {}, table.withColumn("_key", F.col(key).cast("string"))
    for ratio in sorted({s.ratio for s in specs}, reverse=True):
        rows = materialize(balanced_sample(rows, CRASH, ratio, ["_key"]))
        samples[ratio] = materialize(prepared(rows))
    return samples


def model_comparison(
    table: DataFrame, specs: Sequence[ModelSpec] | None = None, key: str = "arc",
    parallelism: int = 4,
) -> DataFrame:
    """(model, algorithm, ratio, leaky, split, n_rows, rmse, mse, mae, r2).

    A fit on a balanced sample is a chain of short jobs, so ``parallelism`` models are
    fitted at a time; a grid search fits two more at a time."""
    specs = model_specs() if specs is None else specs
    samples = samples_for(table, specs, key)

    def measured(spec: ModelSpec) -> DataFrame:
        _, scored, _ = fit_spec(spec, samples[spec.ratio])
        return metrics_by_split(scored, LABEL).select(
            F.lit(spec.name).alias("model"), F.lit(spec.algorithm).alias("algorithm"),
            F.lit(spec.ratio).alias("ratio"), F.lit(spec.leaky).alias("leaky"),
            "split", "n_rows", *METRICS,
        )

    spark = table.sparkSession
    with ThreadPoolExecutor(parallelism) as pool:
        # each thread inherits the session's job properties
        parts = list(pool.map(inheritable_thread_target(spark)(measured), specs))
    return reduce(DataFrame.unionByName, parts)


def model_importance(
    table: DataFrame, spec: ModelSpec, key: str = "arc"
) -> DataFrame:
    """(feature, importance) of one model of the list."""
    sample = samples_for(table, [spec], key)[spec.ratio]
    model, _, names = fit_spec(spec, sample)
    return feature_importance(table.sparkSession, model.featureImportances, names)
