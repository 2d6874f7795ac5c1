"""The relational jobs with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens.catalog.registry import query
from roadlens.catalog.relational_queries import (
    EVENT_HASH, EVENT_ROWS, FLAGGED, HASH, RANGES, WKT, event_rows, flagged,
)
from roadlens.plans import arcs, exploration, reports, risk, routes

EVENT_ATTRIBUTES = (
    "arc_length", "slope", "curve_max_angle", "speed_limit", "road_lanes", "road_priority",
    "tunnel", "bridge", "roundabout",
)
RISK_ATTRIBUTES = (
    "tri", "road_priority", "tunnel", "bridge", "interaction_poi", "slope", "circulation_poi",
    "curve_max_angle", "arc_length", "road_lanes", "speed_limit",
)


def rounded(df, digits: int = 6):
    """Doubles to a fixed number of digits, for comparing results."""
    return df.select(
        [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def _point(part: int, place: int) -> str:
    return (f"round(try_cast(substr(split_part(arc, '_', {part}), {place}, 9) AS INT) / 1000000 "
            "- 500, 6)")


COORDINATES = (f"{_point(1, 1)} AS start_lon, {_point(1, 10)} AS start_lat, "
               f"{_point(2, 1)} AS end_lon, {_point(2, 10)} AS end_lat")


@query("arc_profile", f"""
    WITH e AS (SELECT arc, count(*) AS events_count, {COORDINATES} FROM fx_text_events GROUP BY arc),
         c AS (SELECT arc, count(*) AS crashes_count FROM fx_text_crashes GROUP BY arc)
    SELECT e.arc, events_count, start_lon, start_lat, end_lon, end_lat, {WKT} AS geom_wkt,
           school, hospital, crashes_count
    FROM e LEFT JOIN fx_text_poi p ON p.arc = e.arc LEFT JOIN c ON c.arc = e.arc""")
def arc_profile(t):
    return rounded(arcs.arc_profile(t["fx_text_events"], t["fx_text_poi"], t["fx_text_crashes"]))


DISTRIBUTED = ("weather", "road_cycle", "event_type", "interaction_poi", "circulation_poi", "slope")


@query("category_distribution", """
    SELECT 'county' AS category, county AS value, count(*) AS count FROM fx_trips GROUP BY county
    UNION ALL SELECT 'trip_date', CAST(trip_date AS VARCHAR), count(*) FROM fx_trips
    GROUP BY trip_date""")
def category_distribution(t):
    counties = exploration.category_distribution(t["fx_trips"], "county")
    days = exploration.category_distribution(t["fx_trips"], "trip_date")
    return counties.select(F.lit("county").alias("category"), "value", "count").unionByName(
        days.select(F.lit("trip_date").alias("category"), F.col("value").cast("string"), "count")
    ).orderBy("category", "value")


@query("category_distributions", " UNION ALL ".join(
    f"SELECT '{c}' AS category, CAST({c} AS VARCHAR) AS value, count(*) AS count "
    f"FROM fx_event_rows GROUP BY {c}" for c in DISTRIBUTED))
def category_distributions(t):
    return exploration.category_distributions(t["fx_event_rows"], DISTRIBUTED)


@query("distinct_trips_by", """
    SELECT CAST(trip_date AS VARCHAR) AS value, count(DISTINCT trip_id) AS trips,
           count(*) AS points FROM fx_trips GROUP BY trip_date
    UNION ALL SELECT county, count(DISTINCT trip_id), count(*) FROM fx_trips GROUP BY county""")
def distinct_trips_by(t):
    trips = t["fx_trips"]
    days = exploration.distinct_trips_by(trips, "trip_date")
    counties = exploration.distinct_trips_by(trips, "county")
    texts = days.withColumn("value", F.col("value").cast("string"))
    return texts.unionByName(counties).orderBy("value")


RANKED = """r AS (SELECT arc, end_arc, count(*) AS count FROM fx_text_events GROUP BY arc, end_arc
                 ORDER BY count DESC, arc, end_arc LIMIT 15)"""


@query("dangerous_arcs", f"""
    WITH {RANKED}, d AS (SELECT arc, end_arc, count, {COORDINATES} FROM r)
    SELECT *, {WKT} AS geom_wkt FROM d""")
def dangerous_arcs(t):
    return rounded(exploration.dangerous_arcs(t["fx_text_events"]))


@query("dangerous_arc_endpoints", f"""
    WITH {RANKED}
    SELECT DISTINCT e.arc, round(start_lat, 6) AS start_lat, round(start_lng, 6) AS start_lng,
           round(end_lat, 6) AS end_lat, round(end_lng, 6) AS end_lng, r.count
    FROM r JOIN fx_text_events e ON e.arc = r.arc""")
def dangerous_arc_endpoints(t):
    return rounded(exploration.dangerous_arc_endpoints(t["fx_text_events"]))


@query("dangerous_arc_poi", f"""
    WITH {RANKED}, d AS (SELECT arc, end_arc, count, {COORDINATES} FROM r)
    SELECT d.*, {WKT} AS geom_wkt, school, hospital FROM d JOIN fx_text_poi p ON p.arc = d.arc""")
def dangerous_arc_poi(t):
    return rounded(exploration.dangerous_arc_poi(t["fx_text_events"], t["fx_text_poi"]))


@query("safest_segments", """
    SELECT segment_id, count(*) AS count FROM fx_event_rows GROUP BY segment_id
    ORDER BY count, segment_id LIMIT 15""")
def safest_segments(t):
    return exploration.safest_segments(t["fx_event_rows"])


def _sections(chosen: str) -> str:
    return f"""
    SELECT 'event_type' AS section, event_type AS value, CAST(count(*) AS DOUBLE) AS metric
      FROM {chosen} GROUP BY event_type
    UNION ALL SELECT 'weather', weather, CAST(count(*) AS DOUBLE) FROM {chosen} GROUP BY weather
    UNION ALL SELECT 'speed', 'mean_speed', round(avg(sample_speed), 6) FROM {chosen}
    UNION ALL SELECT 'speed', 'max_speed', max(sample_speed) FROM {chosen}
    UNION ALL SELECT 'speed', 'mean_limit', round(avg(speed_limit), 6) FROM {chosen}"""


@query("arc_drilldown", f"""
    WITH {RANKED}, x AS (SELECT * FROM fx_text_events WHERE arc = (
           SELECT arc FROM r ORDER BY count DESC, arc, end_arc LIMIT 1))""" + _sections("x"))
def arc_drilldown(t):
    return rounded(exploration.arc_drilldown(t["fx_text_events"]))


@query("trip_points", """
    WITH x AS (SELECT trip_id, lat, lng FROM fx_trips WHERE trip_id = 7)
    SELECT CAST(7 AS BIGINT) AS trip_id, round(lat, 6) AS lat, round(lng, 6) AS lng,
           'point' AS kind FROM x
    UNION ALL SELECT 7, round(avg(lat), 6), round(avg(lng), 6), 'centre' FROM x""")
def trip_points(t):
    points = exploration.trip_points(t["fx_trips"], 7)
    return rounded(points.withColumn("trip_id", F.col("trip_id").cast("bigint")))


NEAR = """CASE WHEN (school < 300 AND school > -1) OR (hospital < 300 AND hospital > -1)
               OR (park < 300 AND park > -1) THEN 1 ELSE 0 END"""
# some arcs are known from crashes only
FEATURES = f"""
    WITH e AS (SELECT arc, {', '.join(EVENT_ATTRIBUTES)}, count(*) AS events_count
               FROM fx_event_rows GROUP BY ALL),
         c AS (SELECT arc, count(*) AS crashes_count FROM fx_crashes_beyond GROUP BY arc),
         j AS (SELECT coalesce(e.arc, c.arc) AS arc, e.* EXCLUDE (arc), crashes_count
               FROM e FULL JOIN c ON e.arc = c.arc),
         m AS (SELECT median(road_lanes) AS lanes, median(speed_limit) AS speed FROM j)
    SELECT j.arc, arc_length, slope, curve_max_angle,
           coalesce(CAST(speed_limit AS DOUBLE), speed) AS speed_limit,
           coalesce(CAST(road_lanes AS DOUBLE), lanes) AS road_lanes, road_priority,
           CAST(tunnel AS INT) AS tunnel, CAST(bridge AS INT) AS bridge,
           CAST(roundabout AS INT) AS roundabout,
           coalesce(events_count, 0) AS events_count, coalesce(crashes_count, 0) AS crashes_count,
           aadt, {NEAR} AS near_poi, 0.0::DOUBLE AS crashes_aadt
    FROM j CROSS JOIN m LEFT JOIN fx_aadt a ON a.arc = j.arc LEFT JOIN fx_poi p ON p.arc = j.arc"""


@query("arc_features", FEATURES)
def arc_features(t):
    return arcs.arc_features(
        t["fx_event_rows"], t["fx_crashes_beyond"], t["fx_aadt"], t["fx_poi"], EVENT_ATTRIBUTES,
        exact_medians=True,
    )


def feature_rows(t):
    """Feature rows whose volume is null or NaN for some arcs."""
    return arcs.arc_features(
        t["fx_event_rows"], t["fx_crashes"], t["fx_aadt_nan"], t["fx_poi"], EVENT_ATTRIBUTES
    )


NAMES = {e: arcs.column_name(e) for e in arcs.EVENT_TYPES}


@query("event_mix", "WITH m AS (SELECT arc, " + ", ".join(
    f"count(*) FILTER (WHERE event_type = '{e}') AS {n}" for e, n in NAMES.items()) + """,
    count(*) FILTER (WHERE event_type = 'Seat Belt Event') AS other,
    count(*) FILTER (WHERE event_type IS NULL) AS unknown, count(*) AS total_events
    FROM fx_seven_types GROUP BY arc) SELECT *, """ + ", ".join(
    f"round({n} / total_events, 6) AS {n}_ratio" for n in (*NAMES.values(), "other")) + " FROM m")
def event_mix(t):
    return rounded(arcs.event_mix(t["fx_seven_types"]))


@query("crash_labels", """
    WITH e AS (SELECT arc, count(*) AS total FROM fx_events GROUP BY arc),
         c AS (SELECT arc, count(*) AS count FROM fx_crashes GROUP BY arc)
    SELECT e.arc, coalesce(count, 0) AS count, CASE WHEN count > 0 THEN 1 ELSE 0 END AS crash,
           round(CASE WHEN count > 0 THEN 1 ELSE 0 END / total, 6) AS crash_per_event
    FROM e LEFT JOIN c ON c.arc = e.arc""")
def crash_labels(t):
    return rounded(arcs.crash_labels(t["fx_events"], t["fx_crashes"]))


def _whole(c: str) -> str:
    return f"CAST(trunc({c}) AS BIGINT) AS {c}"


@query("risk_features", f"""
    WITH d AS (SELECT DISTINCT arc, {', '.join(RISK_ATTRIBUTES)} FROM fx_event_rows),
         m AS (SELECT median(road_lanes) AS lanes, median(speed_limit) AS speed FROM d)
    SELECT arc, {_whole('tri')}, {_whole('road_priority')}, CAST(tunnel AS INT) AS tunnel,
           CAST(bridge AS INT) AS bridge, coalesce(interaction_poi, 'None') AS interaction_poi,
           {_whole('slope')}, coalesce(circulation_poi, 'None') AS circulation_poi,
           {_whole('curve_max_angle')}, {_whole('arc_length')},
           CAST(trunc(coalesce(road_lanes, lanes)) AS BIGINT) AS road_lanes,
           CAST(trunc(coalesce(speed_limit, speed)) AS BIGINT) AS speed_limit
    FROM d, m""")
def risk_features(t):
    return arcs.risk_features(t["fx_event_rows"], RISK_ATTRIBUTES, exact_medians=True)


@query("balanced_sample", FLAGGED + f""",
    n AS (SELECT arc, crash, row_number() OVER (ORDER BY {HASH}, arc) AS rn FROM f WHERE crash = 0),
    p AS (SELECT count(*) AS positives FROM f WHERE crash = 1)
    """ + " UNION ALL ".join(
    f"SELECT {r} AS ratio, arc, crash FROM f WHERE crash = 1 "
    f"UNION ALL SELECT {r}, arc, crash FROM n, p WHERE rn <= {r} * positives" for r in (1, 4, 10)))
def balanced_sample(t):
    rows = flagged(t)
    parts = [
        risk.balanced_sample(rows, "crash", r, ["arc"]).select(F.lit(r).alias("ratio"), "arc", "crash")
        for r in (1, 4, 10)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("balanced_sample_events", EVENT_ROWS + f""",
    n AS (SELECT *, row_number() OVER (ORDER BY {HASH}, {EVENT_HASH}, arc, trip_id, event_type) AS rn
          FROM f WHERE crash = 0),
    p AS (SELECT count(*) AS positives FROM f WHERE crash = 1)
    SELECT arc, trip_id, event_type, crash FROM f WHERE crash = 1
    UNION ALL SELECT arc, trip_id, event_type, crash FROM n, p WHERE rn <= 10 * positives""")
def balanced_sample_events(t):
    return risk.balanced_sample(event_rows(t), "crash", 10, ["arc"])


SCORES = """
    a AS (SELECT arc, avg(prediction) AS model_a FROM fx_scores GROUP BY arc),
    b AS (SELECT arc, avg(prediction) AS model_b FROM fx_scores_b GROUP BY arc),
    s AS (SELECT g.*, model_a, model_b FROM fx_segments g LEFT JOIN a ON a.arc = g.arc
          LEFT JOIN b ON b.arc = g.arc)"""


def scored_segments(t):
    models = {"model_a": t["fx_scores"], "model_b": t["fx_scores_b"]}
    return routes.segment_scores(t["fx_segments"], models)


@query("segment_scores", f"""WITH {SCORES}
    SELECT arc, segment_id, seq, distance_m, crash_count, round(model_a, 6) AS model_a,
           round(model_b, 6) AS model_b FROM s""")
def segment_scores(t):
    return rounded(scored_segments(t))


EXPANDED = RANGES + """, x AS (
    SELECT r.trip_id, s.arc, s.segment_id, s.seq, s.distance_m, s.crash_count, true AS is_known
    FROM ranges r JOIN fx_segments s ON s.segment_id = r.segment_id AND s.seq BETWEEN lo AND hi
    UNION ALL SELECT trip_id, arc, NULL, NULL, NULL, NULL, false FROM fx_routes
    WHERE arc NOT IN (SELECT arc FROM fx_segments))"""


@query("expand_routes", EXPANDED + " SELECT * FROM x")
def expand_routes(t):
    return routes.expand_routes(t["fx_routes"], t["fx_segments"])


@query("itinerary_risk", EXPANDED + f""", {SCORES},
    n AS (SELECT route, itinerary_id, trip_id, count(*) AS num_arcs FROM fx_routes GROUP BY 1, 2, 3),
    y AS (SELECT trip_id, count(*) AS num_expanded, sum(x.crash_count) AS crash_sum,
                 sum(model_a) AS model_a, sum(model_b) AS model_b
          FROM x LEFT JOIN s ON s.arc = x.arc GROUP BY trip_id),
    l AS (SELECT trip_id, sum(hi - lo + 1) AS range_arcs FROM ranges GROUP BY trip_id)
    SELECT route, itinerary_id, num_arcs, num_expanded,
           CAST(coalesce(crash_sum, 0) AS BIGINT) AS crash_sum,
           round(coalesce(model_a, 0), 6) AS model_a, round(coalesce(model_b, 0), 6) AS model_b,
           CAST(coalesce(range_arcs, 0) AS BIGINT) AS range_arcs
    FROM n JOIN y ON y.trip_id = n.trip_id LEFT JOIN l ON l.trip_id = n.trip_id""")
def itinerary_risk(t):
    measures = {"crash_sum": "crash_count", "model_a": "model_a", "model_b": "model_b"}
    return rounded(routes.itinerary_risk(t["fx_routes"], scored_segments(t), measures))


@query("classification_report", """
    WITH c AS (SELECT count(*) FILTER (WHERE actual = 1 AND predicted = 1) AS tp,
                      count(*) FILTER (WHERE actual <> 1 AND predicted = 1) AS fp,
                      count(*) FILTER (WHERE actual = 1 AND predicted <> 1) AS fn,
                      count(*) FILTER (WHERE actual <> 1 AND predicted <> 1) AS tn FROM fx_labels)
    SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision,
           round(tp / nullif(tp + fn, 0), 6) AS recall,
           round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1,
           round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy FROM c""")
def classification_report(t):
    return rounded(reports.classification_report(t["fx_labels"], "actual", "predicted"))
