"""Small inputs for the cases the given tables do not hold."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from roadlens.functions import columns as C
from roadlens.functions import geometry as G
from roadlens.operators import aggregates as A
from roadlens.operators import joins as J
from roadlens.operators import projection as P
from roadlens.operators import ranking as R
from roadlens.operators import sets as U
from roadlens.plans import arcs, exploration, reports, risk, routes
from roadlens.session import fresh_path
from roadlens.sources import tables as S

NAN = float("nan")
TYPES = ("Acceleration Event", "Braking Event")


def test_broken_arc_keys_decode_to_null(spark):
    df = spark.createDataFrame(
        [("495000000548000000_495000100548000100",), ("abc",), ("495",), (None,), ("_",)],
        "arc string",
    )
    got = {r["arc"]: r for r in arcs.with_geometry(df).collect()}
    good = got["495000000548000000_495000100548000100"]
    assert good["start_lon"] == pytest.approx(-5.0)
    assert good["end_lat"] == pytest.approx(48.0001)
    assert good["geom_wkt"] == "LINESTRING(-5.000000 48.000000,-4.999900 48.000100)"
    for key in ("abc", None, "_"):
        assert got[key]["start_lon"] is None and got[key]["geom_wkt"] is None
    assert got["495"]["start_lon"] == pytest.approx(495 / 1e6 - 500)
    assert got["495"]["geom_wkt"] is None


def test_split_part_out_of_range(spark):
    df = spark.createDataFrame([("a_b",)], "s string")
    assert df.select(G.split_part("s", "_", 5).alias("x")).first()["x"] is None


def test_ratio_of_zero_and_null(spark):
    df = spark.createDataFrame([(1, 0), (1, None), (0, 0), (1, 2)], "a int, b int")
    got = [r["x"] for r in df.select(C.safe_ratio("a", "b").alias("x")).collect()]
    assert got == [None, None, None, 0.5]


def test_correlation_of_constant_nan_and_null(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 1.0), (1.0, 3.0, 2.0), (NAN, 3.0, 3.0), (1.0, None, 4.0)],
        "a double, b double, c double",
    )
    assert A.corr_pair(df, "a", "b").first()["r"] is None
    assert A.corr_pair(df, "b", "c").first()["r"] == pytest.approx(math.sqrt(3) / 2)
    matrix = {(r["a"], r["b"]): r["r"] for r in A.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert matrix[("a", "c")] is None
    assert matrix[("b", "c")] == pytest.approx(math.sqrt(3) / 2)


def test_near_any_bounds(spark):
    df = spark.createDataFrame([(-1,), (0,), (299,), (300,), (None,)], "d int")
    assert [r["x"] for r in df.select(C.near_any(["d"]).alias("x")).collect()] == [0, 1, 1, 0, 0]


def test_impute_with_nothing_known(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "a double, b int")
    for filled in (P.impute_median(df, ["a"]), P.impute_median(df, ["a"], exact=True),
                   P.impute_mean(df, ["a"])):
        assert [r["a"] for r in filled.collect()] == [None, None]


def test_impute_median_and_mean_skip_nan(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (NAN,), (None,)], "a double")
    exact = [r["a"] for r in P.impute_median(df, ["a"], exact=True).collect()]
    assert exact[-1] == 2.5 and math.isnan(exact[-2])
    assert P.impute_median(df, ["a"]).collect()[-1]["a"] == 2.0
    assert [r["a"] for r in P.impute_mean(df, ["a"]).collect()] == [1, 2, 3, 4, 2.5, 2.5]


def test_cast_of_bad_text_and_nan(spark):
    df = spark.createDataFrame([("7", 2.9), ("x", -2.9), (None, NAN)], "s string, d double")
    got = rows(P.cast_columns(df, {"s": "int", "d": "bigint"}))
    assert got == sorted([(7, 2), (None, -2), (None, None)], key=repr)


def test_top_k_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(i, 5) for i in range(16, 0, -1)], "arc int, count int")
    assert [r["arc"] for r in R.top_k(df, "count", ["arc"]).collect()] == list(range(1, 16))
    assert [r["arc"] for r in R.bottom_k(df, "count", ["arc"]).collect()] == list(range(1, 16))


def test_dedupe_takes_the_smallest_whole_row(spark):
    df = spark.createDataFrame(
        [(1, "b", 1), (1, "a", 9), (2, None, 5), (2, "a", 1), (None, "z", 0)],
        "k int, s string, n int",
    )
    assert rows(R.dedupe_by_key(df, "k")) == sorted(
        [(1, "a", 9), (2, None, 5), (None, "z", 0)], key=repr)


def test_pivot_and_mix_count_null_and_other_types(spark):
    df = spark.createDataFrame(
        [(1, TYPES[0]), (1, None), (1, "Other"), (2, TYPES[1])], "arc int, event_type string"
    )
    pivoted = {r["arc"]: r for r in A.pivot_count(df, "arc", "event_type").collect()}
    assert pivoted[1]["unknown"] == 1 and pivoted[1]["Other"] == 1 and pivoted[2]["Other"] == 0
    mix = {r["arc"]: r for r in arcs.event_mix(df).collect()}
    assert mix[1]["unknown"] == 1 and mix[1]["total_events"] == 3 and mix[1]["other"] == 1
    counts = [*map(arcs.column_name, TYPES), "other", "unknown"]
    assert all(sum(r[c] for c in counts) == r["total_events"] for r in mix.values())
    listed = {r["arc"]: r for r in A.pivot_count(df, "arc", "event_type", TYPES).collect()}
    assert listed[1]["other"] == 1 and listed[1]["unknown"] == 1 and listed[2]["other"] == 0
    assert mix[1]["acceleration_event_ratio"] == pytest.approx(1 / 3)
    assert mix[2]["braking_event_ratio"] == 1.0


def test_crash_labels_leave_out_arcs_without_events(spark):
    events = spark.createDataFrame([(1,), (1,), (2,)], "arc int")
    crashes = spark.createDataFrame([(1,), (1,), (1,), (9,)], "arc int")
    assert rows(arcs.crash_labels(events, crashes)) == [(1, 3, 1, 0.5), (2, 0, 0, 0.0)]
    by_count = arcs.crash_labels(events, crashes, numerator="count")
    assert rows(by_count) == [(1, 3, 1, 1.5), (2, 0, 0, 0.0)]


ROAD = "arc int, length double, road_lanes int, speed_limit int, roundabout boolean, " \
       "tunnel boolean, bridge boolean"


def _arc_inputs(spark):
    events = spark.createDataFrame(
        [(1, 10.0, None, 50, True, False, None), (1, 10.0, None, 50, True, False, None),
         (1, 11.0, 2, 50, True, False, None), (2, 5.0, 4, None, False, False, True)], ROAD)
    crashes = spark.createDataFrame([(2,), (3,), (3,)], "arc int")
    aadt = spark.createDataFrame([(1, 100.0), (3, 7.0)], "arc int, aadt double")
    poi = spark.createDataFrame([(1, 10, -1, None), (3, -1, -1, 300)],
                                "arc int, school int, hospital int, park int")
    return events, crashes, aadt, poi


def test_arc_features_keeps_crash_only_arcs_and_counts_all_events(spark):
    attributes = ("length", "road_lanes", "speed_limit", "roundabout", "tunnel", "bridge")
    got = {r["arc"]: r for r in arcs.arc_features(
        *_arc_inputs(spark), attributes, exact_medians=True).collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[1]["events_count"], got[1]["length"], got[1]["near_poi"]) == (3, 10.0, 1)
    assert (got[3]["events_count"], got[3]["crashes_count"], got[3]["aadt"]) == (0, 2, 7.0)
    assert got[3]["length"] is None and got[3]["near_poi"] == 0
    # arc 1 keeps its smallest attribute row, whose lanes are missing: the median is 4
    assert [got[a]["road_lanes"] for a in (1, 2, 3)] == [4.0, 4.0, 4.0]
    assert got[3]["speed_limit"] == 50.0 and got[2]["bridge"] == 1 and got[1]["bridge"] is None


def test_arc_profile_options(spark):
    key = "495000000548000000_495000100548000100"
    events = spark.createDataFrame([(key,), (key,), (None,)], "arc string")
    poi = spark.createDataFrame([(key, 5), (key, 3)], "arc string, school int")
    none = spark.createDataFrame([], "arc string")
    got = {r["arc"]: r for r in arcs.arc_profile(events, poi, none).collect()}
    assert got[key]["events_count"] == 2 and got[None]["events_count"] == 1 and len(got) == 2
    assert got[key]["school"] == 3 and got[key]["crashes_count"] is None
    filled = arcs.arc_profile(events, poi, none, zero_fill=True)
    assert [r["crashes_count"] for r in filled.collect()] == [0, 0]


def test_risk_rows_equal_their_parts(spark):
    events = spark.createDataFrame(
        [(1, TYPES[0], 2, 30, 1.7, "x", None, True, False),
         (1, None, 2, 30, 1.7, "x", None, True, False),
         (2, TYPES[1], None, None, -1.7, None, "y", False, True)],
        "arc int, event_type string, road_lanes int, speed_limit int, slope double, "
        "interaction_poi string, circulation_poi string, tunnel boolean, bridge boolean")
    crashes = spark.createDataFrame([(1,), (5,)], "arc int")
    attributes = ("road_lanes", "speed_limit", "slope", "interaction_poi", "circulation_poi",
                  "tunnel", "bridge")
    whole = arcs.arc_risk_rows(events, crashes, attributes)
    parts = (
        arcs.risk_features(events, attributes)
        .join(arcs.event_mix(events), "arc").join(arcs.crash_labels(events, crashes), "arc")
    )
    assert rows(whole.select(*parts.columns)) == rows(parts)
    first = whole.where("arc = 2").first()
    assert (first["interaction_poi"], first["slope"], first["road_lanes"]) == ("None", -1, 2)


def test_balanced_sample_limits(spark):
    none = spark.createDataFrame([(1, 0), (2, 0), (3, None)], "arc int, crash int")
    assert risk.balanced_sample(none, "crash", 4, ["arc"]).count() == 0
    few = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 1)], "arc int, crash int")
    assert rows(risk.balanced_sample(few, "crash", 4, ["arc"])) == [(1, 1), (2, 0), (4, 1)]


def test_fold_scores_does_not_multiply_rows(spark):
    base = spark.createDataFrame([(1, 0), (2, 1)], "arc int, seq int")
    twice = spark.createDataFrame([(1, 1.0), (1, 3.0), (9, 5.0)], "arc int, prediction double")
    one = spark.createDataFrame([(2, 7.0)], "arc int, prediction double")
    got = J.fold_scores(base, {"a": twice, "b": one}, "arc")
    assert rows(got) == sorted([(1, 0, 2.0, None), (2, 1, None, 7.0)], key=repr)


SEGMENTS = [(10, 1, 0, 1, None), (11, 1, 1, 2, 0.5), (12, 1, 2, 4, None), (13, 1, 3, 8, None),
            (20, 2, 7, 16, None), (30, None, 1, 32, None), (31, 3, None, 64, None)]


def _routes(spark):
    segments = spark.createDataFrame(
        SEGMENTS, "arc int, segment_id int, seq int, crash_count int, score double")
    points = [("r", 1, "r_1", 99), ("r", 1, "r_1", 99),              # nothing known, twice
              ("r", 2, "r_2", 12), ("r", 2, "r_2", 10),              # one segment, reversed
              ("r", 3, "r_3", 20), ("r", 3, "r_3", 20),              # the same arc twice
              ("s", 1, "s_1", 30), ("s", 1, "s_1", 31), ("s", 1, "s_1", 13)]
    return spark.createDataFrame(
        points, "route string, itinerary_id int, trip_id string, arc int"), segments


def test_expand_routes_edges(spark):
    got = routes.expand_routes(*_routes(spark)).select("trip_id", "arc", "seq", "is_known")
    assert rows(got) == sorted([
        ("r_1", 99, None, False), ("r_1", 99, None, False),
        ("r_2", 10, 0, True), ("r_2", 11, 1, True), ("r_2", 12, 2, True),
        ("r_3", 20, 7, True),
        ("s_1", 13, 3, True), ("s_1", 30, None, False), ("s_1", 31, None, False)], key=repr)


def test_itinerary_risk_edges(spark):
    measures = {"crash_sum": "crash_count", "model": "score"}
    got = rows(routes.itinerary_risk(*_routes(spark), measures))
    assert got == [("r", 1, 2, 2, 0, 0.0, 0), ("r", 2, 2, 3, 7, 0.5, 3),
                   ("r", 3, 2, 1, 16, 0.0, 1), ("s", 1, 3, 3, 8, 0.0, 1)]


def test_trip_points_of_unknown_trip(spark):
    trips = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 4.0)],
                                  "trip_id string, lat double, lng double")
    assert rows(exploration.trip_points(trips, "a"), "lat", "lng", "kind") == [
        (1.0, 2.0, "point"), (2.0, 3.0, "centre"), (3.0, 4.0, "point")]
    assert rows(exploration.trip_points(trips, "b"), "lat", "kind") == [(None, "centre")]


def test_distinct_trips_ignore_null_trip_but_count_points(spark):
    trips = spark.createDataFrame([("x", 1), ("x", 1), ("x", None), (None, 2)],
                                  "county string, trip_id int")
    assert rows(exploration.distinct_trips_by(trips, "county")) == sorted(
        [("x", 1, 3), (None, 1, 1)], key=repr)


def test_arc_drilldown_skips_null_type_group_only_in_value(spark):
    events = spark.createDataFrame(
        [("a", "b", None, "sun", 10.0, 50), ("a", "b", "t", "sun", 30.0, None),
         ("c", "d", "t", "sun", 1.0, 1)],
        "arc string, end_arc string, event_type string, weather string, sample_speed double, "
        "speed_limit int")
    got = rows(exploration.arc_drilldown(events))
    assert got == sorted([("event_type", None, 1.0), ("event_type", "t", 1.0),
                          ("weather", "sun", 2.0), ("speed", "mean_speed", 20.0),
                          ("speed", "max_speed", 30.0), ("speed", "mean_limit", 50.0)], key=repr)
    assert rows(exploration.top_arc_drilldown(events)) == got


def test_report_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "actual int, predicted int")
    got = reports.classification_report(df, "actual", "predicted").first()
    assert (got["tn"], got["precision"], got["f1"], got["accuracy"]) == (2, None, None, 1.0)


def test_report_of_recorded_cells(spark):
    cells = [(0, 0, 468166), (0, 1, 1466), (1, 0, 0), (1, 1, 2215)]
    df = spark.createDataFrame(cells, "actual int, predicted int, n int")
    df = df.where("n > 0").select("actual", "predicted", F.explode(F.sequence(F.lit(1), "n")))
    got = reports.classification_report(df, "actual", "predicted").first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (2215, 1466, 0, 468166)
    assert round(got["precision"], 4) == 0.6017 and round(got["f1"], 4) == 0.7514
    assert round(got["accuracy"], 4) == 0.9969


def test_append_checks_and_aligns_columns(spark):
    path = fresh_path(spark, "append")
    S.write_overwrite(spark.createDataFrame([(1, 2.0)], "a int, b double"), path)
    S.write_append(spark.createDataFrame([(7.0, 5)], "b double, a bigint"), path)
    assert rows(S.read_table(spark, path), "a", "b") == [(1, 2.0), (5, 7.0)]
    with pytest.raises(ValueError, match="missing"):
        S.write_append(spark.createDataFrame([(1,)], "a int"), path)


def test_other_formats_read_back(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, s string")
    for fmt, options in (("json", {}), ("csv", {"header": "true"}), ("orc", {})):
        path = fresh_path(spark, fmt)
        S.write_overwrite(df, path, fmt, options)
        again = S.read_table(spark, path, fmt, options)
        assert rows(again.select(F.col("a").cast("int"), "s")) == [(1, "x"), (2, "y")]


def test_except_and_union_by_name(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, s string")
    b = spark.createDataFrame([("y", 2)], "s string, k int")
    assert rows(U.except_rows(a, b)) == [(1, "x")]
    assert rows(U.union_all(a, b)) == [(1, "x"), (1, "x"), (2, "y"), (2, "y")]
