"""Planned routes: score segments, fill skipped arcs, sum risk per itinerary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.operators.aggregates import group_min_max, group_sums, range_length_sum
from roadlens.operators.joins import fold_scores, join_range, spread_join
from roadlens.operators.sets import union_missing
from roadlens.session import materialize


def segment_scores(
    segments: DataFrame, scores: Mapping[str, DataFrame], key: str = "arc",
    value: str = "prediction",
) -> DataFrame:
    """The segment table with one column per model, the arc's mean prediction."""
    return fold_scores(segments, scores, key, value)


def placed_segments(
    segments: DataFrame, segment: str = "segment_id", position: str = "seq"
) -> DataFrame:
    """Segment rows that have a place; the others cannot be on a route."""
    return segments.where(F.col(segment).isNotNull() & F.col(position).isNotNull())


def place_points(
    routes: DataFrame, segments: DataFrame, trip: str = "trip_id", key: str = "arc",
    segment: str = "segment_id", position: str = "seq",
) -> DataFrame:
    """Every route point with its place; points on arcs the segment table does not know
    have none. Arcs that most trips use are spread over many tasks."""
    places = placed_segments(segments, segment, position).select(key, segment, position)
    return spread_join(routes.select(trip, key), places, key, "left")


def visited_ranges(
    points: DataFrame, trip: str = "trip_id", segment: str = "segment_id", position: str = "seq"
) -> DataFrame:
    """(trip, segment, lo, hi): first and last position each trip visits on a segment."""
    return group_min_max(points.where(F.col(segment).isNotNull()), [trip, segment], position)


def fill_points(
    points: DataFrame, segments: DataFrame, trip: str = "trip_id", key: str = "arc",
    segment: str = "segment_id", position: str = "seq",
) -> DataFrame:
    """Placed points filled up to whole ranges, and the points without a place."""
    known = placed_segments(segments, segment, position)
    ranges = visited_ranges(points, trip, segment, position)
    filled = join_range(ranges, known, segment, position).drop("lo", "hi")
    unknown = points.where(F.col(segment).isNull()).select(trip, key)
    return union_missing(
        filled.withColumn("is_known", F.lit(True)), unknown.withColumn("is_known", F.lit(False))
    ).select(trip, *segments.columns, "is_known")


def expand_routes(
    routes: DataFrame, segments: DataFrame, trip: str = "trip_id", key: str = "arc",
    segment: str = "segment_id", position: str = "seq",
) -> DataFrame:
    """Every arc between the first and last visited position of each segment, once per
    trip, and each route point on an arc the segment table does not know.

    All trips are expanded in one plan; the placed points are materialized, as both the
    ranges and the unknown points come from them."""
    points = materialize(place_points(routes, segments, trip, key, segment, position))
    return fill_points(points, segments, trip, key, segment, position)


def itinerary_risk(
    routes: DataFrame,
    segments: DataFrame,
    measures: Mapping[str, str],
    itinerary: Sequence[str] = ("route", "itinerary_id"),
    trip: str = "trip_id",
    key: str = "arc",
    segment: str = "segment_id",
    position: str = "seq",
) -> DataFrame:
    """One row per itinerary: arcs before and after filling, the summed measures
    (``{output name: segment column}``) and the arcs its ranges span."""
    points = materialize(place_points(routes, segments, trip, key, segment, position))
    expanded = fill_points(points, segments, trip, key, segment, position)
    named = expanded.select(trip, *[F.col(c).alias(n) for n, c in measures.items()])
    sums = group_sums(named, [trip], list(measures)).withColumnRenamed("rows", "num_expanded")
    ranges = visited_ranges(points, trip, segment, position)
    lengths = range_length_sum(ranges, [trip], name="range_arcs")
    given = routes.groupBy(*itinerary, trip).agg(F.count(F.lit(1)).alias("num_arcs"))
    return (
        given.join(sums, trip).join(lengths, trip, "left").na.fill(0, ["range_arcs"])
        .select(*itinerary, "num_arcs", "num_expanded", *measures, "range_arcs")
    )
