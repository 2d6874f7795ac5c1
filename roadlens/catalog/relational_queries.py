"""Sources, projections, filters, joins, aggregates, ranking, sets and scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens.catalog.registry import query
from roadlens.functions import columns as C
from roadlens.functions import geometry as G
from roadlens.operators import aggregates as A
from roadlens.operators import joins as J
from roadlens.operators import projection as P
from roadlens.operators import quantiles as Q
from roadlens.operators import ranking as R
from roadlens.operators import sampling as M
from roadlens.operators import sets as U
from roadlens.plans.arcs import EVENT_TYPES, column_name
from roadlens.session import fresh_path
from roadlens.sources import tables as S

# ---- sources and sinks


@query("scan_table", "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def scan_table(t):
    return S.read_table(t.spark, f"{t.folder}/part.parquet").select(
        "p_partkey", "p_brand", "p_size", "p_retailprice"
    )


@query("scan_model_tables", """
    SELECT 'customer' AS table_name, count(*) AS n FROM customer
    UNION ALL SELECT 'part', count(*) FROM part
    UNION ALL SELECT 'supplier', count(*) FROM supplier""")
def scan_model_tables(t):
    found = S.read_tables(
        t.spark, ["customer", "part", "supplier"], prefix=f"{t.folder}/", suffix=".parquet"
    )
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, df in found.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("sink_overwrite", "SELECT arc, aadt FROM fx_aadt WHERE aadt IS NOT NULL")
def sink_overwrite(t):
    path = fresh_path(t.spark, "sink-overwrite")
    S.write_overwrite(t["fx_aadt"], path)
    S.write_overwrite(P.filter_not_null(t["fx_aadt"], "aadt"), path)
    return S.read_table(t.spark, path)


@query("sink_append", "SELECT arc, coalesce(aadt, -1.0) AS aadt FROM fx_aadt")
def sink_append(t):
    path = fresh_path(t.spark, "sink-append")
    known, missing = U.split_rows(t["fx_aadt"], F.col("aadt").isNotNull())
    S.write_overwrite(known, path)
    S.write_append(missing.select(F.lit(-1).alias("aadt"), "arc"), path)
    return S.read_table(t.spark, path)


@query("sink_parts", """
    SELECT arc, coalesce(aadt, -1.0) AS aadt,
           CASE WHEN aadt IS NULL THEN 'predicted' ELSE 'recorded' END AS part FROM fx_aadt""")
def sink_parts(t):
    path = fresh_path(t.spark, "sink-parts")
    known, missing = U.split_rows(t["fx_aadt"], F.col("aadt").isNotNull())
    S.write_part(known, path, "recorded")
    for _ in range(2):  # as a retry would
        S.write_part(missing.select(F.lit(-1.0).alias("aadt"), "arc"), path, "predicted")
    return S.read_table(t.spark, path)


@query("inline_rows", """
    SELECT v.weather, v.label, count(*) AS n
    FROM fx_events e JOIN (VALUES ('A', 'dry'), ('N', 'wet'), ('R', 'fog')) v(weather, label)
      ON e.weather = v.weather GROUP BY 1, 2""")
def inline_rows(t):
    names = S.inline_rows(
        t.spark, [("A", "dry"), ("N", "wet"), ("R", "fog")], "weather string, label string"
    )
    counted = A.group_count(t["fx_events"], "weather", name="n")
    return J.join_inner(counted, names, "weather").select("weather", "label", "n")


# ---- projections, casts, nulls


@query("project_columns", "SELECT arc, trip_id, event_type, trip_date FROM fx_events")
def project_columns(t):
    return P.project_columns(t["fx_events"], ["arc", "trip_id", "event_type", "trip_date"])


@query("project_expr", "SELECT arc AS arc_id, sample_speed AS speed FROM fx_events")
def project_expr(t):
    return P.project_expr(t["fx_events"], "arc as arc_id", "sample_speed as speed")


@query("rename_column", "SELECT arc AS arc_id, segment_id, seq FROM fx_segments")
def rename_column(t):
    return P.rename_column(t["fx_segments"], "ARC", "arc_id").select("arc_id", "segment_id", "seq")


@query("drop_columns", "SELECT arc, segment_id, seq, crash_count FROM fx_segments")
def drop_columns(t):
    return P.drop_columns(t["fx_segments"], "distance_m", "not_there")


@query("literal_column", "SELECT arc, 0 AS crashes_aadt, 'none' AS source FROM fx_crashes")
def literal_column(t):
    return P.literal_columns(t["fx_crashes"], {"crashes_aadt": 0, "source": "none"})


@query("cast_columns", """
    SELECT arc, try_cast(arc_hash AS INT) AS arc_hash, CAST(trunc(arc_length) AS BIGINT) AS arc_length,
           CAST(tunnel AS INT) AS tunnel, CAST(speed_limit AS DOUBLE) AS speed_limit
    FROM fx_arcs""")
def cast_columns(t):
    rows = t["fx_arcs"].select("arc", "arc_hash", "arc_length", "tunnel", "speed_limit")
    return P.cast_columns(rows, {
        "arc_hash": "int", "arc_length": "bigint", "tunnel": "int", "speed_limit": "double"
    })


@query("cast_by_type", """
    SELECT CAST(arc AS DOUBLE) AS arc, arc_hash, CAST(segment_id AS DOUBLE) AS segment_id, tunnel,
           CAST(speed_limit AS DOUBLE) AS speed_limit, slope FROM fx_arcs""")
def cast_by_type(t):
    rows = t["fx_arcs"].select("arc", "arc_hash", "segment_id", "tunnel", "speed_limit", "slope")
    return P.cast_by_type(rows)


@query("bool_to_double", """
    SELECT arc, CASE WHEN tunnel THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS tunnel,
           CASE WHEN nullif(bridge, arc % 2 = 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS bridge
    FROM fx_arcs""")
def bool_to_double(t):
    bridge = F.nullif(F.col("bridge"), F.col("arc") % 2 == 0)
    return t["fx_arcs"].select(
        "arc", C.bool_to_double("tunnel").alias("tunnel"), C.bool_to_double(bridge).alias("bridge")
    )


@query("null_to_literal", """
    SELECT arc, coalesce(interaction_poi, 'None') AS interaction_poi FROM fx_arcs""")
def null_to_literal(t):
    return t["fx_arcs"].select("arc", C.null_to("interaction_poi", "None").alias("interaction_poi"))


@query("fill_constants", """
    SELECT arc, coalesce(speed_limit, 0) AS speed_limit, coalesce(slope, -1.5) AS slope,
           road_lanes FROM fx_arcs""")
def fill_constants(t):
    rows = t["fx_arcs"].select("arc", "speed_limit", "slope", "road_lanes")
    return P.fill_constants(rows, {"speed_limit": 0, "slope": -1.5})


@query("impute_median", """
    WITH m AS (SELECT median(speed_limit) AS a, median(road_lanes) AS b, median(slope) AS c
               FROM fx_arcs)
    SELECT arc, coalesce(speed_limit, a) AS speed_limit, coalesce(road_lanes, b) AS road_lanes,
           coalesce(slope, c) AS slope FROM fx_arcs, m""")
def impute_median(t):
    rows = t["fx_arcs"].select("arc", "speed_limit", "road_lanes", "slope")
    return P.impute_median(rows, ["speed_limit", "road_lanes", "slope"], exact=True)


@query("impute_mean", """
    WITH m AS (SELECT avg(speed_limit) AS a, avg(slope) AS b FROM fx_arcs)
    SELECT arc, round(coalesce(speed_limit, a), 6) AS speed_limit,
           round(coalesce(slope, b), 6) AS slope FROM fx_arcs, m""")
def impute_mean(t):
    rows = P.impute_mean(t["fx_arcs"].select("arc", "speed_limit", "slope"),
                         ["speed_limit", "slope"])
    return rows.select("arc", F.round("speed_limit", 6).alias("speed_limit"),
                       F.round("slope", 6).alias("slope"))


@query("drop_null_rows", """
    SELECT arc, slope, speed_limit, road_lanes FROM fx_arcs
    WHERE slope IS NOT NULL AND speed_limit IS NOT NULL""")
def drop_null_rows(t):
    rows = t["fx_arcs"].select("arc", "slope", "speed_limit", "road_lanes")
    return P.drop_null_rows(rows, ["slope", "speed_limit"])


@query("safe_ratio", """
    SELECT arc, round(arc_length / nullif(seq, 0), 6) AS ratio FROM fx_arcs""")
def safe_ratio(t):
    return t["fx_arcs"].select("arc", F.round(C.safe_ratio("arc_length", "seq"), 6).alias("ratio"))


@query("row_sum", """
    SELECT arc, seq + curve_max_angle + road_priority AS total FROM fx_arcs""")
def row_sum(t):
    rows = P.add_row_sum(t["fx_arcs"], ["seq", "curve_max_angle", "road_priority"], "total")
    return rows.select("arc", "total")


@query("ratio_columns", """
    WITH s AS (SELECT arc, seq, road_priority, seq + road_priority AS total FROM fx_arcs)
    SELECT arc, round(CAST(seq AS DOUBLE) / nullif(total, 0), 6) AS seq_ratio,
           round(CAST(road_priority AS DOUBLE) / nullif(total, 0), 6) AS road_priority_ratio
    FROM s""")
def ratio_columns(t):
    rows = P.add_row_sum(t["fx_arcs"], ["seq", "road_priority"], "total")
    out = P.ratio_columns(rows, ["seq", "road_priority"], "total")
    return out.select("arc", F.round("seq_ratio", 6).alias("seq_ratio"),
                      F.round("road_priority_ratio", 6).alias("road_priority_ratio"))


# ---- filters


@query("filter_equal", """
    SELECT arc, trip_id, trip_date FROM fx_events WHERE event_type = 'Speeding Event'""")
def filter_equal(t):
    return P.filter_equal(t["fx_events"], "event_type", "Speeding Event").select(
        "arc", "trip_id", "trip_date"
    )


@query("filter_not_null", """
    SELECT 'known' AS side, arc, aadt FROM fx_aadt WHERE aadt IS NOT NULL
    UNION ALL SELECT 'missing', arc, aadt FROM fx_aadt WHERE aadt IS NULL""")
def filter_not_null(t):
    rows = t["fx_aadt"]
    known = P.filter_not_null(rows, "aadt").select(F.lit("known").alias("side"), "arc", "aadt")
    missing = P.filter_null(rows, "aadt").select(F.lit("missing").alias("side"), "arc", "aadt")
    return known.unionByName(missing)


@query("filter_not_nan", """
    SELECT arc, aadt FROM fx_aadt_nan WHERE aadt IS NULL OR NOT isnan(aadt)""")
def filter_not_nan(t):
    return P.filter_not_nan(t["fx_aadt_nan"], "aadt")


@query("filter_in_list", """
    SELECT arc, segment_id, seq FROM fx_segments WHERE arc IN (SELECT arc FROM fx_routes)""")
def filter_in_list(t):
    listed = t["fx_routes"].select("arc")
    return P.filter_in_list(t["fx_segments"].select("arc", "segment_id", "seq"), "arc", listed)


@query("near_poi_flag", """
    SELECT arc, CASE WHEN (school < 300 AND school > -1) OR (hospital < 300 AND hospital > -1)
                       OR (park < 300 AND park > -1) THEN 1 ELSE 0 END AS near_poi
    FROM fx_poi""")
def near_poi_flag(t):
    return t["fx_poi"].select("arc", C.near_any(["school", "hospital", "park"]).alias("near_poi"))


@query("filter_between", """
    SELECT arc, segment_id, seq FROM fx_segments WHERE seq BETWEEN 10 AND 30""")
def filter_between(t):
    return P.filter_between(t["fx_segments"], "seq", 10, 30).select("arc", "segment_id", "seq")


# ---- joins

COUNTS = """
    WITH e AS (SELECT arc, count(*) AS events_count FROM fx_events GROUP BY arc),
         c AS (SELECT arc, count(*) AS crashes_count FROM fx_crashes GROUP BY arc)"""


def _counts(t):
    return (J.key_counts(t["fx_events"], "arc", "events_count"),
            J.key_counts(t["fx_crashes"], "arc", "crashes_count"))


@query("join_inner", COUNTS + " SELECT e.arc, events_count, crashes_count FROM e JOIN c USING (arc)")
def join_inner(t):
    events, crashes = _counts(t)
    return J.join_inner(events, crashes, "arc")


@query("join_left", COUNTS + """
    SELECT e.arc, events_count, crashes_count FROM e LEFT JOIN c USING (arc)""")
def join_left(t):
    events, crashes = _counts(t)
    return J.join_left(events, crashes, "arc")


@query("join_full_outer", """
    WITH a AS (SELECT arc, count(*) AS events_count FROM fx_events GROUP BY arc),
         c AS (SELECT arc, count(*) AS crashes_count FROM fx_crashes_beyond GROUP BY arc)
    SELECT coalesce(a.arc, c.arc) AS arc, events_count, crashes_count
    FROM a FULL JOIN c ON a.arc = c.arc""")
def join_full_outer(t):
    crashes = J.key_counts(t["fx_crashes_beyond"], "arc", "crashes_count")
    return J.join_full(J.key_counts(t["fx_events"], "arc", "events_count"), crashes, "arc")


@query("join_fold_scores", """
    WITH a AS (SELECT arc, avg(prediction) AS model_a FROM fx_scores GROUP BY arc),
         b AS (SELECT arc, avg(prediction) AS model_b FROM fx_scores_b GROUP BY arc)
    SELECT s.arc, segment_id, seq, round(model_a, 6) AS model_a, round(model_b, 6) AS model_b
    FROM fx_segments s LEFT JOIN a ON a.arc = s.arc LEFT JOIN b ON b.arc = s.arc""")
def join_fold_scores(t):
    scores = {"model_a": t["fx_scores"], "model_b": t["fx_scores_b"]}
    rows = J.fold_scores(t["fx_segments"], scores, "arc")
    return rows.select("arc", "segment_id", "seq", F.round("model_a", 6).alias("model_a"),
                       F.round("model_b", 6).alias("model_b"))


@query("join_left_semi", "SELECT arc, aadt FROM fx_aadt WHERE arc IN (SELECT arc FROM fx_crashes)")
def join_left_semi(t):
    return J.join_semi(t["fx_aadt"], t["fx_crashes"], "arc")


@query("join_left_anti", """
    SELECT trip_id, arc FROM fx_routes WHERE arc NOT IN (SELECT arc FROM fx_segments)""")
def join_left_anti(t):
    return J.join_anti(t["fx_routes"].select("trip_id", "arc"), t["fx_segments"], "arc")


RANGES = """
    WITH ranges AS (SELECT trip_id, segment_id, min(seq) AS lo, max(seq) AS hi
                    FROM fx_routes r JOIN fx_segments s ON r.arc = s.arc GROUP BY 1, 2)"""


def _ranges(t):
    visits = t["fx_routes"].select("trip_id", "arc").distinct()
    placed = J.join_inner(visits, t["fx_segments"].select("arc", "segment_id", "seq"), "arc")
    return A.group_min_max(placed, ["trip_id", "segment_id"], "seq")


@query("join_segment_range", RANGES + """
    SELECT trip_id, r.segment_id, lo, hi, s.arc, s.seq
    FROM ranges r JOIN fx_segments s ON s.segment_id = r.segment_id AND s.seq BETWEEN lo AND hi""")
def join_segment_range(t):
    master = t["fx_segments"].select("arc", "segment_id", "seq")
    return J.join_range(_ranges(t), master, "segment_id", "seq", width=16)


@query("join_back_count", """
    SELECT arc, trip_id, event_type, events_count FROM fx_events
    JOIN (SELECT arc, count(*) AS events_count FROM fx_events GROUP BY arc) USING (arc)""")
def join_back_count(t):
    rows = t["fx_events"].select("arc", "trip_id", "event_type")
    return J.join_back_count(rows, "arc", "events_count")


@query("join_using", """
    SELECT arc, trip_id, weather, aadt FROM fx_events JOIN fx_aadt USING (arc)""")
def join_using(t):
    return J.join_inner(t["fx_events"].select("arc", "trip_id", "weather"), t["fx_aadt"], "arc")


# ---- aggregates


@query("group_count", "SELECT arc, count(*) AS count FROM fx_events GROUP BY arc")
def group_count(t):
    return A.group_count(t["fx_events"], "arc")


@query("group_count_two_keys", """
    SELECT arc, event_type, count(*) AS count FROM fx_events GROUP BY arc, event_type""")
def group_count_two_keys(t):
    return A.group_count(t["fx_events"], "arc", "event_type")


@query("group_count_alias", "SELECT arc, count(*) AS crashes FROM fx_crashes GROUP BY arc")
def group_count_alias(t):
    return A.group_count(t["fx_crashes"], "arc", name="crashes")


@query("group_count_distinct", """
    SELECT trip_date, count(DISTINCT trip_id) AS trips FROM fx_trips GROUP BY trip_date""")
def group_count_distinct(t):
    return A.group_count_distinct(t["fx_trips"], "trip_date", "trip_id", "trips")


@query("pivot_count", "SELECT arc, " + ", ".join(
    f"count(*) FILTER (WHERE event_type = '{e}') AS {column_name(e)}" for e in EVENT_TYPES)
    + ", count(*) FILTER (WHERE event_type = 'Seat Belt Event') AS other"
    ", count(*) FILTER (WHERE event_type IS NULL) AS unknown FROM fx_seven_types GROUP BY arc")
def pivot_count(t):
    rows = A.pivot_count(t["fx_seven_types"], "arc", "event_type", EVENT_TYPES)
    return rows.select("arc", *[F.col(e).alias(column_name(e)) for e in EVENT_TYPES], "other", "unknown")


@query("global_mean_max", """
    SELECT round(avg(sample_speed), 6) AS mean_value, max(sample_speed) AS max_value
    FROM fx_events""")
def global_mean_max(t):
    rows = A.global_mean_max(t["fx_events"], "sample_speed")
    return rows.select(F.round("mean_value", 6).alias("mean_value"), "max_value")


@query("multi_column_mean", """
    SELECT round(avg(slope), 6) AS slope, round(avg(speed_limit), 6) AS speed_limit,
           round(avg(arc_length), 6) AS arc_length FROM fx_arcs""")
def multi_column_mean(t):
    names = ["slope", "speed_limit", "arc_length"]
    rows = A.multi_column_mean(t["fx_arcs"], names)
    return rows.select([F.round(c, 6).alias(c) for c in names])


@query("mean_position", """
    SELECT round(avg(lat), 6) AS mean_lat, round(avg(lng), 6) AS mean_lng FROM fx_trips""")
def mean_position(t):
    rows = A.mean_position(t["fx_trips"], "lat", "lng")
    return rows.select([F.round(c, 6).alias(c) for c in ("mean_lat", "mean_lng")])


@query("conditional_count", """
    SELECT count(*) AS rows, count(*) FILTER (WHERE weather = 'R') AS rainy,
           count(*) FILTER (WHERE event_type IS NULL) AS untyped FROM fx_events""")
def conditional_count(t):
    return A.conditional_count(
        t["fx_events"], rainy=F.col("weather") == "R", untyped=F.col("event_type").isNull()
    )


@query("null_profile", """
    WITH p AS (SELECT count(*) FILTER (WHERE slope IS NULL) AS a,
                      count(*) FILTER (WHERE speed_limit IS NULL) AS b,
                      count(*) FILTER (WHERE interaction_poi IS NULL) AS c FROM fx_arcs)
    SELECT 'slope' AS column_name, a AS missing FROM p
    UNION ALL SELECT 'speed_limit', b FROM p UNION ALL SELECT 'interaction_poi', c FROM p
    UNION ALL SELECT '_total', a + b + c FROM p""")
def null_profile(t):
    return A.null_profile(t["fx_arcs"], ["slope", "speed_limit", "interaction_poi"])


@query("null_flags", """
    SELECT arc IS NULL AS arc, slope IS NULL AS slope, speed_limit IS NULL AS speed_limit
    FROM fx_arcs""")
def null_flags(t):
    return P.null_flags(t["fx_arcs"], ["arc", "slope", "speed_limit"])


@query("column_quantile", """
    SELECT 'arc_length' AS column_name, 0.25::DOUBLE AS probability,
           round(quantile_cont(arc_length, 0.25), 6) AS value FROM fx_arcs
    UNION ALL SELECT 'arc_length', 0.5, round(quantile_cont(arc_length, 0.5), 6) FROM fx_arcs
    UNION ALL SELECT 'slope', 0.25, round(quantile_cont(slope, 0.25), 6) FROM fx_arcs
    UNION ALL SELECT 'slope', 0.5, round(quantile_cont(slope, 0.5), 6) FROM fx_arcs""")
def column_quantile(t):
    levels = [0.25, 0.5]
    found = Q.exact_quantiles(t["fx_arcs"], ["arc_length", "slope"], levels)
    rows = [(c, p, round(v, 6)) for c, vs in found.items() for p, v in zip(levels, vs)]
    return t.spark.createDataFrame(rows, "column_name string, probability double, value double")


@query("column_quantile_sketch", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {p}::DOUBLE AS probability, "
    f"CAST(quantile_disc({c}, {p}) AS DOUBLE) AS value FROM fx_arcs"
    for c in ("arc_length", "slope") for p in (0.25, 0.5, 0.75)))
def column_quantile_sketch(t):
    return A.column_quantiles(t["fx_arcs"], ["arc_length", "slope"], [0.25, 0.5, 0.75])


@query("corr_pair", "SELECT round(corr(sample_speed, speed_change), 6) AS r FROM fx_events")
def corr_pair(t):
    rows = A.corr_pair(t["fx_events"], "sample_speed", "speed_change")
    return rows.select(F.round("r", 6).alias("r"))


@query("corr_matrix", """
    SELECT 'slope' AS a, 'speed_limit' AS b, round(corr(slope, speed_limit), 6) AS r FROM fx_arcs
    UNION ALL SELECT 'slope', 'arc_length', round(corr(slope, arc_length), 6) FROM fx_arcs
    UNION ALL SELECT 'slope', 'seq', round(corr(slope, seq), 6) FROM fx_arcs
    UNION ALL SELECT 'speed_limit', 'arc_length', round(corr(speed_limit, arc_length), 6) FROM fx_arcs
    UNION ALL SELECT 'speed_limit', 'seq', round(corr(speed_limit, seq), 6) FROM fx_arcs
    UNION ALL SELECT 'arc_length', 'seq', round(corr(arc_length, seq), 6) FROM fx_arcs""")
def corr_matrix(t):
    rows = A.corr_matrix(t["fx_arcs"], ["slope", "speed_limit", "arc_length", "seq"])
    return rows.select("a", "b", F.round("r", 6).alias("r"))


@query("corr_vector", """
    WITH s AS (SELECT slope, speed_limit, arc_length FROM fx_arcs
               WHERE slope IS NOT NULL AND speed_limit IS NOT NULL AND arc_length IS NOT NULL)
    SELECT 'slope' AS a, 'speed_limit' AS b, round(corr(slope, speed_limit), 6) AS r FROM s
    UNION ALL SELECT 'slope', 'arc_length', round(corr(slope, arc_length), 6) FROM s
    UNION ALL SELECT 'speed_limit', 'arc_length', round(corr(speed_limit, arc_length), 6) FROM s""")
def corr_vector(t):
    rows = A.corr_vector(t["fx_arcs"], ["slope", "speed_limit", "arc_length"])
    return rows.select("a", "b", F.round("r", 6).alias("r"))


def _stats_sql(c: str) -> str:
    return (f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, "
            f"round(stddev_samp({c}), 6) AS stddev, CAST(min({c}) AS DOUBLE) AS min, "
            f"CAST(max({c}) AS DOUBLE) AS max FROM fx_arcs")


@query("summary_stats", _stats_sql("slope") + " UNION ALL " + _stats_sql("arc_length"))
def summary_stats(t):
    rows = A.summary_stats(t["fx_arcs"], ["slope", "arc_length"])
    return rows.select("column_name", "n", F.round("mean", 6).alias("mean"),
                       F.round("stddev", 6).alias("stddev"), "min", "max")


@query("group_min_max", RANGES + " SELECT trip_id, segment_id, lo, hi FROM ranges")
def group_min_max(t):
    return _ranges(t)


@query("group_sums", """
    SELECT segment_id, count(*) AS rows, round(coalesce(sum(slope), 0), 6) AS slope,
           coalesce(CAST(sum(road_lanes) AS BIGINT), 0) AS road_lanes
    FROM fx_arcs GROUP BY segment_id""")
def group_sums(t):
    rows = A.group_sums(t["fx_arcs"], ["segment_id"], ["slope", "road_lanes"])
    return rows.select("segment_id", "rows", F.round("slope", 6).alias("slope"), "road_lanes")


@query("distinct_rows", "SELECT DISTINCT arc, event_type, weather FROM fx_events")
def distinct_rows(t):
    return A.distinct_rows(t["fx_events"].select("arc", "event_type", "weather"))


@query("dedupe_by_key", """
    SELECT arc, event_type, weather, sample_speed FROM (
      SELECT arc, event_type, weather, sample_speed, row_number() OVER (PARTITION BY arc
        ORDER BY event_type NULLS FIRST, weather NULLS FIRST, sample_speed NULLS FIRST) AS rn
      FROM fx_events) WHERE rn = 1""")
def dedupe_by_key(t):
    rows = t["fx_events"].select("arc", "event_type", "weather", "sample_speed")
    return R.dedupe_by_key(rows, "arc")


@query("distinct_sorted", "SELECT DISTINCT route, itinerary_id FROM fx_routes ORDER BY 1, 2")
def distinct_sorted(t):
    return A.distinct_sorted(t["fx_routes"], "route", "itinerary_id")


@query("range_length_sum", RANGES + """
    SELECT trip_id, CAST(sum(hi - lo + 1) AS BIGINT) AS length FROM ranges GROUP BY trip_id""")
def range_length_sum(t):
    return A.range_length_sum(_ranges(t), ["trip_id"])


@query("confusion_counts", """
    SELECT actual, predicted, count(*) AS count FROM fx_labels GROUP BY 1, 2""")
def confusion_counts(t):
    return A.confusion_counts(t["fx_labels"], "actual", "predicted")


@query("confusion_matrix", """
    SELECT actual, count(*) FILTER (WHERE predicted = 0) AS predicted_0,
           count(*) FILTER (WHERE predicted = 1) AS predicted_1 FROM fx_labels GROUP BY actual""")
def confusion_matrix(t):
    return A.confusion_matrix(t["fx_labels"], "actual", "predicted", [0, 1])


# ---- ranking


@query("sort_desc", "SELECT arc, count(*) AS count FROM fx_events GROUP BY arc ORDER BY 2 DESC, 1")
def sort_desc(t):
    return R.sort_desc(A.group_count(t["fx_events"], "arc"), "count", "arc")


@query("top_k", """
    SELECT arc, count(*) AS count FROM fx_events GROUP BY arc ORDER BY count DESC, arc LIMIT 15""")
def top_k(t):
    return R.top_k(A.group_count(t["fx_events"], "arc"), "count", ["arc"])


@query("bottom_k", """
    SELECT arc, count(*) AS count FROM fx_events GROUP BY arc ORDER BY count, arc LIMIT 15""")
def bottom_k(t):
    return R.bottom_k(A.group_count(t["fx_events"], "arc"), "count", ["arc"])


@query("top1_drilldown", """
    SELECT arc, trip_id, event_type, trip_date FROM fx_events WHERE arc = (
      SELECT arc FROM fx_events GROUP BY arc ORDER BY count(*) DESC, arc LIMIT 1)""")
def top1_drilldown(t):
    return R.rows_of_top_key(t["fx_events"].select("arc", "trip_id", "event_type", "trip_date"),
                             "arc")


@query("sort_asc", "SELECT trip_date, count(*) AS count FROM fx_events GROUP BY 1 ORDER BY 1")
def sort_asc(t):
    return R.sort_asc(A.group_count(t["fx_events"], "trip_date"), "trip_date")


HASH = "('0x' || substr(md5('42:' || arc), 1, 8))::UBIGINT"
FLAGGED = """
    WITH f AS (SELECT a.arc, CASE WHEN c.arc IS NULL THEN 0 ELSE 1 END AS crash
               FROM fx_aadt a LEFT JOIN (SELECT DISTINCT arc FROM fx_crashes) c ON a.arc = c.arc)"""


def flagged(t):
    crashed = t["fx_crashes"].distinct().withColumn("crash", F.lit(1))
    joined = J.join_left(t["fx_aadt"].select("arc"), crashed, "arc")
    return joined.na.fill(0, ["crash"])


@query("limit_ratio", FLAGGED + f"""
    SELECT arc, crash FROM (SELECT arc, crash, row_number() OVER (ORDER BY {HASH}, arc) AS rn
                            FROM f WHERE crash = 0)
    WHERE rn <= 4 * (SELECT count(*) FROM f WHERE crash = 1)""")
def limit_ratio(t):
    return M.limit_ratio(flagged(t), "crash", ["arc"], 4)


EVENT_HASH = """('0x' || substr(md5('42:' || arc || '|' || trip_id || '|' || coalesce(event_type, '') || '|'
    || crash), 1, 8))::UBIGINT"""
EVENT_ROWS = """
    WITH f AS (SELECT arc, trip_id, event_type, CASE WHEN trip_id % 50 = 0 THEN 1 ELSE 0 END AS crash
               FROM fx_events)"""


def event_rows(t):
    crash = F.when(F.col("trip_id") % 50 == 0, 1).otherwise(0)
    return t["fx_events"].select("arc", "trip_id", "event_type", crash.alias("crash"))


@query("limit_ratio_events", EVENT_ROWS + f"""
    SELECT arc, trip_id, event_type, crash FROM (
      SELECT *, row_number() OVER (ORDER BY {HASH}, {EVENT_HASH}, arc, trip_id, event_type) AS rn
      FROM f WHERE crash = 0)
    WHERE rn <= 4 * (SELECT count(*) FROM f WHERE crash = 1)""")
def limit_ratio_events(t):
    return M.limit_ratio(event_rows(t), "crash", ["arc"], 4)


# ---- sets


@query("union_all", """
    SELECT arc, prediction FROM fx_scores UNION ALL SELECT arc, prediction FROM fx_scores_b""")
def union_all(t):
    return U.union_all(t["fx_scores"], t["fx_scores_b"].select("prediction", "arc"))


@query("except_rows", """
    SELECT arc, weather FROM fx_events EXCEPT
    SELECT arc, weather FROM fx_events WHERE event_type IS NULL""")
def except_rows(t):
    rows = t["fx_events"]
    return U.except_rows(rows.select("arc", "weather"),
                         P.filter_null(rows, "event_type").select("weather", "arc"))


@query("except_keys_fill", """
    SELECT arc, count(*) AS count, 1 AS crash FROM fx_crashes GROUP BY arc
    UNION ALL SELECT arc, CAST(0 AS BIGINT), 0 FROM (
      SELECT arc FROM fx_events EXCEPT SELECT arc FROM fx_crashes)""")
def except_keys_fill(t):
    counted = A.group_count(t["fx_crashes"], "arc").withColumn("crash", C.positive_flag("count"))
    return U.except_keys_fill(counted, t["fx_events"], "arc", {"count": 0, "crash": 0})


@query("union_missing_columns", """
    SELECT arc, segment_id, seq FROM fx_segments
    UNION ALL SELECT arc, NULL, NULL FROM fx_routes
      WHERE arc NOT IN (SELECT arc FROM fx_segments)""")
def union_missing_columns(t):
    segments = t["fx_segments"].select("arc", "segment_id", "seq")
    return U.union_missing(segments, J.join_anti(t["fx_routes"].select("arc"), segments, "arc"))


# ---- scalar functions


@query("split_part", """
    SELECT arc, split_part(arc_hash, '_', 1) AS first, split_part(arc_hash, '_', 2) AS second,
           CAST(NULL AS VARCHAR) AS third FROM fx_arcs""")
def split_part(t):
    return t["fx_arcs"].select("arc", *[
        G.split_part("arc_hash", "_", i).alias(n) for i, n in enumerate(("first", "second", "third"))
    ])


@query("substring_int", """
    SELECT arc, try_cast(substr(arc_hash, 1, 9) AS INT) AS lon,
           CASE WHEN regexp_full_match(substr(arc_hash, 15, 9), '[0-9]+')
                THEN CAST(substr(arc_hash, 15, 9) AS INT) END AS broken FROM fx_arcs""")
def substring_int(t):
    return t["fx_arcs"].select("arc", G.substring_int("arc_hash", 1, 9).alias("lon"),
                               G.substring_int("arc_hash", 15, 9).alias("broken"))


@query("decode_coordinate", """
    SELECT arc, round(CAST(substr(arc_hash, 1, 9) AS INT) / 1000000 - 500, 6) AS lon FROM fx_arcs""")
def decode_coordinate(t):
    lon = G.decode_coordinate(G.substring_int("arc_hash", 1, 9))
    return t["fx_arcs"].select("arc", F.round(lon, 6).alias("lon"))


DECODED = """
    WITH d AS (SELECT arc,
      CAST(substr(arc_hash, 1, 9) AS INT) / 1000000 - 500 AS start_lon,
      CAST(substr(arc_hash, 10, 9) AS INT) / 1000000 - 500 AS start_lat,
      CAST(substr(split_part(arc_hash, '_', 2), 1, 9) AS INT) / 1000000 - 500 AS end_lon,
      CAST(substr(split_part(arc_hash, '_', 2), 10, 9) AS INT) / 1000000 - 500 AS end_lat
      FROM fx_arcs)"""
WKT = "printf('LINESTRING(%.6f %.6f,%.6f %.6f)', start_lon, start_lat, end_lon, end_lat)"


@query("decode_arc", DECODED + """
    SELECT arc, round(start_lon, 6) AS start_lon, round(start_lat, 6) AS start_lat,
           round(end_lon, 6) AS end_lon, round(end_lat, 6) AS end_lat FROM d""")
def decode_arc(t):
    points = G.decode_arc("arc_hash")
    return t["fx_arcs"].select("arc", *[F.round(c, 6).alias(n) for n, c in points.items()])


@query("wkt_linestring", DECODED + f" SELECT arc, {WKT} AS geom_wkt FROM d")
def wkt_linestring(t):
    line = G.wkt_linestring(*G.decode_arc("arc_hash").values())
    return t["fx_arcs"].select("arc", line.alias("geom_wkt"))


@query("concat_key", """
    SELECT route, itinerary_id, arc, route || '_' || itinerary_id AS trip FROM fx_routes""")
def concat_key(t):
    return t["fx_routes"].select("route", "itinerary_id", "arc",
                                 C.concat_key("route", "itinerary_id").alias("trip"))


@query("positive_flag", """
    SELECT arc, CASE WHEN crash_count > 0 THEN 1 ELSE 0 END AS crash FROM fx_segments""")
def positive_flag(t):
    return t["fx_segments"].select("arc", C.positive_flag("crash_count").alias("crash"))
