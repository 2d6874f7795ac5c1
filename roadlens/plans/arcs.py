"""Per-arc tables: profile, features, event mix, crash labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.functions.columns import (
    near_any, null_to, positive_flag, safe_ratio,
)
from roadlens.functions.geometry import decode_arc, wkt_linestring
from roadlens.models.features import fit_encoding
from roadlens.operators.joins import key_counts
from roadlens.operators.projection import cast_columns, impute_median, ratio_columns
from roadlens.operators.ranking import dedupe_by_key
from roadlens.session import materialize

# fixed values: the six named event types
EVENT_TYPES = (
    "Acceleration Event",
    "Braking Event",
    "Excessive Speeding",
    "Phone Handling Event",
    "Potential Collision Event",
    "Speeding Event",
)


def with_geometry(df: DataFrame, key: str = "arc") -> DataFrame:
    """Add the coordinates packed in the arc key and their line."""
    placed = df.withColumns(decode_arc(key))
    return placed.withColumn(
        "geom_wkt", wkt_linestring("start_lon", "start_lat", "end_lon", "end_lat")
    )


def arc_profile(
    events: DataFrame, poi: DataFrame, crashes: DataFrame, key: str = "arc",
    zero_fill: bool = False,
) -> DataFrame:
    """One row per arc with events: event count, geometry, POI distances, crash count.

    Arcs without crashes keep a null count unless ``zero_fill``."""
    counted = key_counts(events, key, "events_count")
    profile = (
        with_geometry(counted, key)
        .join(dedupe_by_key(poi, key), key, "left")
        .join(key_counts(crashes, key, "crashes_count"), key, "left")
    )
    return profile.na.fill(0, ["crashes_count"]) if zero_fill else profile


def arc_attributes(events: DataFrame, attributes: Sequence[str], key: str = "arc") -> DataFrame:
    """One row per arc: its attributes and events_count.

    Events collapse to distinct (arc, attributes) before anything is shuffled; of an
    arc recorded with several attribute sets the smallest is kept."""
    known = events.where(F.col(key).isNotNull())
    grouped = key_counts(known, [key, *attributes], "_rows")
    merged = grouped.groupBy(key).agg(
        F.min(F.struct(*attributes)).alias("_row"), F.sum("_rows").alias("events_count")
    )
    return merged.select(key, "_row.*", "events_count")


def arc_features(
    events: DataFrame,
    crashes: DataFrame,
    aadt: DataFrame,
    poi: DataFrame,
    attributes: Sequence[str],
    flags: Sequence[str] = ("roundabout", "tunnel", "bridge"),
    medians: Sequence[str] = ("road_lanes", "speed_limit"),
    poi_columns: Sequence[str] = ("school", "hospital", "park"),
    near: float = 300,
    exact_medians: bool = False,
    key: str = "arc",
    volume: str = "aadt",
) -> DataFrame:
    """One feature row per arc that has events or crashes.

    An arc known from crashes only keeps its key, with null road attributes. The joined
    arcs are materialized, so that the medians do not read the events again."""
    arcs = arc_attributes(events, attributes, key)
    volumes = aadt.groupBy(key).agg(F.avg(F.col(volume).cast("double")).alias(volume))
    closeness = poi.groupBy(key).agg(F.max(near_any(poi_columns, near)).alias("near_poi"))
    joined = (
        arcs.join(key_counts(crashes.where(F.col(key).isNotNull()), key, "crashes_count"), key, "full")
        .join(volumes, key, "left")
        .join(closeness, key, "left")
        .na.fill(0, ["events_count", "crashes_count"])
    )
    typed = joined.withColumns(
        {f: F.col(f).cast("int") for f in flags} | {"near_poi": null_to("near_poi", 0)}
    )
    filled = impute_median(materialize(typed), medians, exact_medians)
    return filled.withColumn("crashes_aadt", F.lit(0.0))


def column_name(text: str) -> str:
    return text.lower().replace(" ", "_")


def type_counts(
    events: DataFrame, keys: Sequence[str], types: Sequence[str] = EVENT_TYPES,
    category: str = "event_type",
) -> DataFrame:
    """Events per named type, of any other type (``other``), without a type (``unknown``)
    and in total, per key; the counts add up to the total."""
    return events.groupBy(*keys).agg(
        *[F.count_if(F.col(category) == t).alias(column_name(t)) for t in types],
        F.count_if(~F.col(category).isin(*types)).alias("other"),
        F.count_if(F.col(category).isNull()).alias("unknown"),
        F.count(F.lit(1)).alias("total_events"),
    )


def event_mix(
    events: DataFrame, types: Sequence[str] = EVENT_TYPES, key: str = "arc",
    category: str = "event_type",
) -> DataFrame:
    """Events per type, in total and as ratios, one row per arc."""
    counted = type_counts(events, [key], types, category)
    return ratio_columns(counted, [*map(column_name, types), "other"], "total_events")


def with_crash_label(
    arcs: DataFrame, crashes: DataFrame, total: str, key: str = "arc", numerator: str = "crash"
) -> DataFrame:
    """Add count, crash and crash_per_event to a table with one row per arc. Arcs
    without crashes get zeros; crashes elsewhere are left out."""
    counted = arcs.join(key_counts(crashes, key), key, "left").na.fill(0, ["count"])
    return counted.withColumn("crash", positive_flag("count")).withColumn(
        "crash_per_event", safe_ratio(numerator, total)
    )


def crash_labels(
    events: DataFrame, crashes: DataFrame, key: str = "arc", numerator: str = "crash"
) -> DataFrame:
    """(arc, count, crash, crash_per_event) for every arc with events.

    The rate divides the 0/1 crash flag by the arc's events; ``numerator="count"``
    divides the number of crashes."""
    totals = key_counts(events, key, "_total").where(F.col(key).isNotNull())
    return with_crash_label(totals, crashes, "_total", key, numerator).drop("_total")


def typed_attributes(
    arcs: DataFrame,
    attributes: Sequence[str],
    categories: Sequence[str] = ("interaction_poi", "circulation_poi"),
    medians: Sequence[str] = ("road_lanes", "speed_limit"),
    flags: Sequence[str] = ("tunnel", "bridge"),
    exact_medians: bool = False,
) -> DataFrame:
    """Missing categories become ``None``, missing lanes and limits the median, numbers
    are truncated to long and flags become 0/1."""
    named = arcs.withColumns({c: null_to(c, "None") for c in categories})
    filled = impute_median(named, medians, exact_medians)
    numbers = [a for a in attributes if a not in {*categories, *flags}]
    return cast_columns(filled, {n: "bigint" for n in numbers} | {f: "int" for f in flags})


def risk_features(
    events: DataFrame, attributes: Sequence[str], key: str = "arc", **options
) -> DataFrame:
    """One typed row per arc with events; ``options`` are those of ``typed_attributes``."""
    rows = dedupe_by_key(events.select(key, *attributes), key)
    return typed_attributes(materialize(rows), attributes, **options)


def arc_risk_rows(
    events: DataFrame, crashes: DataFrame, attributes: Sequence[str], key: str = "arc", **options
) -> DataFrame:
    """Typed attributes, event mix and crash labels of every arc with events.

    The same rows as joining ``risk_features``, ``event_mix`` and ``crash_labels``, but
    the events are read once: they collapse to counts per (arc, attributes), and those
    to one row per arc."""
    names = [column_name(t) for t in EVENT_TYPES]
    grouped = type_counts(events.where(F.col(key).isNotNull()), [key, *attributes])
    counts = [*names, "other", "unknown", "total_events"]
    merged = grouped.groupBy(key).agg(
        F.min(F.struct(*attributes)).alias("_row"), *[F.sum(c).alias(c) for c in counts]
    )
    labelled = with_crash_label(
        merged.select(key, "_row.*", *counts), crashes, "total_events", key
    )
    typed = typed_attributes(materialize(labelled), attributes, **options)
    return ratio_columns(typed, [*names, "other"], "total_events")


def encode_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<column>_index`` and one-hot ``<column>_encoded``."""
    return fit_encoding(df, columns).transform(df)
