"""Distributions, rankings and drill-downs over events and trips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.operators.aggregates import mean_position
from roadlens.operators.joins import key_counts
from roadlens.operators.ranking import bottom_k, dedupe_by_key, rows_of_top_key, top_k
from roadlens.operators.sets import union_missing
from roadlens.plans.arcs import with_geometry


def category_distribution(events: DataFrame, column: str) -> DataFrame:
    """(value, count); null is a category of its own. Sort what is shown, after any union."""
    return key_counts(events, column).select(F.col(column).alias("value"), "count")


def category_distributions(events: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(category, value, count) of several columns from one pass over the events, with
    values as text."""
    texts = events.select([F.col(c).cast("string").alias(c) for c in columns])
    return key_counts(
        texts.unpivot([], list(columns), "category", "value"), ["category", "value"]
    ).orderBy("category", "value")


def distinct_trips_by(trips: DataFrame, column: str, trip: str = "trip_id") -> DataFrame:
    """(value, trips, points): distinct trips beside recorded points.

    Points are first counted per (value, trip), so a day or county with most of the
    rows is merged from partial counts."""
    per_trip = trips.groupBy(column, trip).agg(F.count(F.lit(1)).alias("points"))
    return per_trip.groupBy(F.col(column).alias("value")).agg(
        F.count(trip).alias("trips"), F.sum("points").alias("points"))


def dangerous_arcs(
    events: DataFrame, k: int = 15, start: str = "arc", end: str = "end_arc"
) -> DataFrame:
    """The k (start, end) arcs with most events, with the geometry of the start arc."""
    counts = key_counts(events, [start, end])
    return with_geometry(top_k(counts, "count", [start, end], k), start)


def dangerous_arc_endpoints(
    events: DataFrame, k: int = 15, start: str = "arc", end: str = "end_arc",
    recorded: tuple[str, ...] = ("start_lat", "start_lng", "end_lat", "end_lng"),
) -> DataFrame:
    """Distinct recorded endpoints of events on the k most dangerous arcs. The ranking
    has k rows and is broadcast into the event scan."""
    ranked = top_k(key_counts(events, [start, end]), "count", [start, end], k)
    points = events.select(start, *recorded)
    return points.join(F.broadcast(ranked.select(start, "count")), start).distinct()


def dangerous_arc_poi(
    events: DataFrame, poi: DataFrame, k: int = 15, start: str = "arc", end: str = "end_arc"
) -> DataFrame:
    """The k most dangerous arcs that have POI distances, with those distances."""
    ranked = dangerous_arcs(events, k, start, end)
    return dedupe_by_key(poi, start).join(F.broadcast(ranked), start)


def safest_segments(events: DataFrame, k: int = 15, segment: str = "segment_id") -> DataFrame:
    """The k segments with fewest events among those that have any."""
    return bottom_k(key_counts(events, segment), "count", [segment], k)


def arc_drilldown(
    events: DataFrame, key: str = "arc", event_type: str = "event_type",
    weather: str = "weather", speed: str = "sample_speed", limit: str = "speed_limit",
    end: str = "end_arc",
) -> DataFrame:
    """(section, value, metric) of the arc that leads the danger ranking.

    One pass over its events groups by type and weather at once; the sections are
    rolled up from those partial groups."""
    ranked = top_k(key_counts(events, [key, end]), "count", [key, end], 1).select(key)
    chosen = events.join(F.broadcast(ranked), key, "left_semi")
    return _sections(chosen, event_type, weather, speed, limit)


def top_arc_drilldown(
    events: DataFrame, key: str = "arc", event_type: str = "event_type",
    weather: str = "weather", speed: str = "sample_speed", limit: str = "speed_limit",
) -> DataFrame:
    """The same sections for the start arc with the most events."""
    return _sections(rows_of_top_key(events, key), event_type, weather, speed, limit)


def _sections(chosen: DataFrame, event_type: str, weather: str, speed: str, limit: str):
    """The chosen events are read once: they collapse to one row per type and weather, and
    grouping sets over those few rows give both mixes and the totals. No events, no rows."""
    partial = chosen.groupBy(F.col(event_type).alias("_type"), F.col(weather).alias("_weather")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(speed).cast("double")).alias("speed_sum"),
        F.count(speed).alias("speed_n"), F.max(speed).alias("speed_max"),
        F.sum(F.col(limit).cast("double")).alias("limit_sum"), F.count(limit).alias("limit_n"),
    )
    sets = partial.groupingSets([["_type"], ["_weather"], []], "_type", "_weather").agg(
        F.grouping("_type").alias("_no_type"), F.grouping("_weather").alias("_no_weather"),
        F.sum("rows").cast("double").alias("rows"),
        F.try_divide(F.sum("speed_sum"), F.sum("speed_n")).alias("mean_speed"),
        F.max("speed_max").cast("double").alias("max_speed"),
        F.try_divide(F.sum("limit_sum"), F.sum("limit_n")).alias("mean_limit"),
    )

    def entry(section: str, value: Column, metric: str) -> Column:
        return F.struct(F.lit(section).alias("section"), value.cast("string").alias("value"), F.col(metric).alias("metric"))

    speeds = [entry("speed", F.lit(name), name) for name in ("mean_speed", "max_speed", "mean_limit")]
    rows = (F.when(F.col("_no_type") == 0, F.array(entry("event_type", F.col("_type"), "rows")))
            .when(F.col("_no_weather") == 0, F.array(entry("weather", F.col("_weather"), "rows")))
            .otherwise(F.array(*speeds)))
    return sets.select(F.inline(rows))


def trip_points(
    trips: DataFrame, trip_id, lat: str = "lat", lng: str = "lng", trip: str = "trip_id"
) -> DataFrame:
    """The points of one trip and a row, marked ``centre``, of their mean position."""
    points = trips.where(F.col(trip) == F.lit(trip_id)).select(trip, lat, lng)
    centre = mean_position(points, lat, lng).select(
        F.col("mean_lat").alias(lat), F.col("mean_lng").alias(lng)
    )
    marked = union_missing(
        points.withColumn("kind", F.lit("point")), centre.withColumn("kind", F.lit("centre"))
    )
    return marked.withColumn(trip, F.lit(trip_id))
