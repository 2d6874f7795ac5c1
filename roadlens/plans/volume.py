"""Traffic volume and crash rate: learn where they are known, predict where missing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.functions.columns import is_known, safe_ratio
from roadlens.models.features import assemble_features_keep, slot_names
from roadlens.models.learners import forest
from roadlens.models.metrics import feature_importance, regression_metrics
from roadlens.session import materialize
from roadlens.sources.tables import write_part

# fixed values: model inputs
VOLUME_FEATURES = (
    "arc_length", "road_priority", "roundabout", "road_lanes", "tunnel", "bridge",
    "speed_limit", "curve_max_angle", "events_count", "crashes_count", "near_poi",
)
ROAD_FEATURES = (
    "road_priority", "roundabout", "tunnel", "bridge", "curve_max_angle", "speed_limit",
    "near_poi",
)
TREES = 10


@dataclass(frozen=True)
class FittedTarget:
    """A forest fitted on the rows whose target is known, and all rows it scored."""

    model: Model
    names: list[str]
    scored: DataFrame
    target: str

    def metrics(self) -> DataFrame:
        """Training metrics."""
        return regression_metrics(self.scored.where("_known"), self.target)

    def importance(self) -> DataFrame:
        spark = self.scored.sparkSession
        return feature_importance(spark, self.model.featureImportances, self.names)


def fit_target(
    features: DataFrame, label: Column, target: str, columns: Sequence[str], trees: int = TREES
) -> FittedTarget:
    """Known rows train, every row is scored. A row belongs to the training part when
    its label is neither null nor NaN, so no row is in both."""
    labelled = features.withColumn(target, label.cast("double"))
    ready = assemble_features_keep(
        labelled.withColumn("_known", F.coalesce(is_known(target), F.lit(False))), columns
    )
    rows = materialize(ready)
    model = forest(target, trees).fit(rows.where("_known"))
    return FittedTarget(model, slot_names(ready), model.transform(rows), target)


def impute_target(
    features: DataFrame,
    target: str = "aadt",
    columns: Sequence[str] = VOLUME_FEATURES,
    crashes: str = "crashes_count",
    key: str = "arc",
) -> DataFrame:
    """The target of every arc, recorded or predicted, and crashes over it."""
    fitted = fit_target(features, F.col(target), target, columns)
    value = F.when(F.col("_known"), F.col(target)).otherwise(F.col("prediction"))
    return fitted.scored.select(
        key, *columns, value.alias(target), safe_ratio(F.col(crashes), value).alias("crashes_aadt"),
        (~F.col("_known")).alias("is_predicted"),
    )


def predict_rate(
    features: DataFrame,
    volume: str = "aadt",
    columns: Sequence[str] = VOLUME_FEATURES,
    crashes: str = "crashes_count",
    key: str = "arc",
) -> DataFrame:
    """Crashes per volume of every arc: computed where the volume is known and not
    zero, predicted elsewhere."""
    rate = safe_ratio(crashes, volume)
    label = F.when(is_known(F.col(volume).cast("double")), rate)
    fitted = fit_target(features, label, "crashes_aadt", columns)
    value = F.when(F.col("_known"), F.col("crashes_aadt")).otherwise(F.col("prediction"))
    return fitted.scored.select(
        key, *columns, volume, value.alias("crashes_aadt"),
        (~F.col("_known")).alias("is_predicted"),
    )


def write_imputed(done: DataFrame, name: str, fmt: str = "parquet") -> None:
    """Write the result of ``impute_target`` or ``predict_rate`` in two parts, recorded and
    predicted, either of which can be written again after a failure."""
    for part, predicted in (("recorded", False), ("predicted", True)):
        write_part(done.where(F.col("is_predicted") == predicted).drop("is_predicted"), name, part, fmt)
