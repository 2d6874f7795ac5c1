"""Crash counts explained by event-level conditions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.functions.columns import bool_to_double, positive_flag
from roadlens.models.features import MAX_CATEGORIES, assembler, large_vocabularies
from roadlens.models.learners import ZeroInflatedPair, binomial, poisson
from roadlens.models.least_squares import cross_products, head_means, solve
from roadlens.models.metrics import (
    bernoulli_statistics, glm_report, glm_statistics, named_values, regression_metrics,
)
from roadlens.models.vocabulary import INDEX, Vocabulary, fit_vocabulary, weighted_counts
from roadlens.operators.joins import join_left, key_counts, spread_join
from roadlens.operators.sampling import with_split
from roadlens.session import materialize


def event_crash_counts(
    events: DataFrame, crashes: DataFrame, key: str = "arc",
    hot: list[tuple[int, int]] | None = None,
) -> DataFrame:
    """Every event with its arc's crash count, 0 where there is none. Arcs with most of
    the events are spread over many tasks; ``hot`` is as in ``spread_join``."""
    counts = key_counts(crashes, key, "count")
    return spread_join(events, counts, key, "left", hot).na.fill(0, ["count"])


def crash_count_regression(
    events: DataFrame,
    crashes: DataFrame,
    numeric: Sequence[str],
    flags: Sequence[str],
    split_keys: Sequence[str],
    key: str = "arc",
    seed: int = 123,
) -> DataFrame:
    """(name, value): coefficients, intercept and test metrics of a linear model of the
    crash count of an event's arc.

    The events are read twice, beside a look at their first rows, and never written: once for the cross products of the training
    rows, from which the driver solves the normal equations, and once for the errors of
    the test rows. The joined rows go straight into an aggregate of one row, so a plain join
    serves: adaptive execution splits the partition of a busy arc."""
    typed = events.select(
        key, *[F.col(c) for c in split_keys if c != key],
        *[F.col(c).cast("double").alias(c) for c in numeric],
        *[bool_to_double(c).alias(c) for c in flags],
    )
    columns = [*numeric, *flags]
    counted = join_left(typed.na.drop(subset=columns), key_counts(crashes, key, "count"), key).na.fill(0, ["count"])
    marked = with_split(counted, split_keys, 80, seed)
    train = marked.where("split = 'train'").select(*columns, "count")
    near = head_means(typed, columns)
    fit = solve(cross_products(train, [*columns, "count"], near=near)[()], "count")
    test = marked.where("split = 'test'").select("count", fit.prediction().alias("prediction"))
    metrics = regression_metrics(test, "count")
    measured = metrics.unpivot([], ["rmse", "mse", "mae", "r2"], "name", "value")
    names, values = zip(*fit.values(), strict=True)
    return named_values(events.sparkSession, names, values, "name", "value").unionByName(measured)


def category_crash_rows(
    events: DataFrame, crashes: DataFrame, categories: Sequence[str], key: str = "arc"
) -> DataFrame:
    """Distinct (categories, count, crash) with the number of events behind each.

    A GLM sees equal events only through their number, so fitting these weighted rows
    gives the coefficients of the event-level fit from far fewer rows. Events collapse
    per arc before they meet the crash counts."""
    collapsed = key_counts(events, [key, *categories], "events")
    counted = collapsed.join(key_counts(crashes, key, "count"), key, "left").na.fill(0, ["count"])
    return (
        counted.withColumn("crash", positive_flag("count"))
        .groupBy(*categories, "count", "crash")
        .agg(F.sum("events").cast("double").alias("weight"))
    )


@dataclass(frozen=True)
class CategoryIndex:
    """Indexes of categories by names that the driver knows, or by a table."""

    named: tuple[StringIndexerModel, ...]
    large: Vocabulary

    def transform(self, df: DataFrame) -> DataFrame:
        for model in self.named:
            df = model.transform(df)
        return self.large.index(df)


@dataclass(frozen=True)
class CrashPair:
    """Both models over indexed categories, the indexing that feeds them, and the
    weighted rows each was fitted on."""

    models: ZeroInflatedPair
    indexing: CategoryIndex
    counts: DataFrame
    rates: DataFrame


def fit_crash_pair(
    events: DataFrame, crashes: DataFrame, categories: Sequence[str], key: str = "arc",
    limit: int = MAX_CATEGORIES,
) -> CrashPair:
    """The count model sees distinct (categories, count) rows, the crash model the share
    of events on crash arcs per combination of categories: Spark starts a binomial fit
    from the labels, and heavy 0/1 rows would start it too far out."""
    rows = materialize(category_crash_rows(events, crashes, categories, key))
    indexing = _frequency_index(rows, categories, limit)
    indexes = [c + INDEX for c in categories]
    vectors = assembler(indexes)
    indexed = indexing.transform(rows)
    counts = materialize(vectors.transform(indexed).select("features", "count", "weight"))
    shares = indexed.groupBy(*indexes).agg(
        (F.sum(F.col("weight") * F.col("crash")) / F.sum("weight")).alias("crash"),
        F.sum("weight").alias("weight"),
    )
    rates = materialize(vectors.transform(shares).select("features", "crash", "weight"))
    models = ZeroInflatedPair(
        binomial("crash", "weight").fit(rates), poisson("count", "weight").fit(counts)
    )
    return CrashPair(models, indexing, counts, rates)


def _frequency_index(rows: DataFrame, categories: Sequence[str], limit: int = MAX_CATEGORIES):
    """An indexer whose categories are ordered by the summed weight of each, as event rows
    would order them. The driver gets the names of columns of up to about ``limit`` categories,
    as from any string indexer; larger vocabularies stay in a table."""
    large = large_vocabularies(rows, categories, limit)
    table = weighted_counts(rows, [c for c in categories if c not in large], "weight")
    ranked = table.orderBy(F.col("n").desc(), "value").collect() if len(large) < len(categories) else []
    labels = {c: [r["value"] for r in ranked if r["name"] == c] for c in categories if c not in large}
    # one model a column: lists of unequal length together would be filled up with nulls
    named = tuple(
        StringIndexerModel.from_labels(found, inputCol=c, outputCol=c + INDEX, handleInvalid="keep")
        for c, found in labels.items())
    return CategoryIndex(named, fit_vocabulary(rows, large, "weight"))


def crash_count_glm(
    events: DataFrame, crashes: DataFrame, categories: Sequence[str], key: str = "arc"
) -> DataFrame:
    """(model, name, value, std_error) of the Poisson count and binomial crash models."""
    pair = fit_crash_pair(events, crashes, categories, key)
    count, crash = pair.models.count, pair.models.crash
    n_rows = int(pair.counts.agg(F.sum("weight")).first()[0])
    crash_statistics = bernoulli_statistics(
        crash.transform(pair.rates), "crash", "weight", "prediction", crash.summary.rank
    )
    return glm_report(
        events.sparkSession,
        {"count": (count, glm_statistics(count, n_rows)), "crash": (crash, crash_statistics)},
        [c + INDEX for c in categories],
    )
