"""Stand-in road tables over the given star schema.

Each text is one SELECT that Spark and DuckDB read alike; ``{part}`` and the like stand
for the given tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from roadlens.sources.tables import read_table

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "labels")


def _arc_text(key: str) -> str:
    return f"""concat(
         CAST(495000000 + ({key}) * 13 AS STRING), CAST(548000000 + ({key}) * 7 AS STRING), '_',
         CAST(495000100 + ({key}) * 13 AS STRING), CAST(548000100 + ({key}) * 7 AS STRING))"""


EVENT_TYPE = """CASE l_linenumber WHEN 1 THEN 'Acceleration Event' WHEN 2 THEN 'Braking Event'
            WHEN 3 THEN 'Excessive Speeding' WHEN 4 THEN 'Phone Handling Event'
            WHEN 5 THEN 'Potential Collision Event' WHEN 6 THEN 'Speeding Event' END"""

ROAD = """p_retailprice AS arc_length,
       CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_partkey % 17 AS DOUBLE) - 8 END AS slope,
       CAST(p_partkey % 23 AS DOUBLE) AS curve_max_angle,
       CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size + 30 END AS speed_limit,
       nullif(p_size % 5, 0) AS road_lanes,
       CAST(substr(p_brand, 7) AS INT) % 6 AS road_priority,
       p_partkey % 31 = 0 AS tunnel,
       p_partkey % 19 = 0 AS bridge,
       p_partkey % 13 = 0 AS roundabout,
       CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_type END AS interaction_poi"""

CRASH_ROWS = "l_returnflag = 'R' AND l_discount > 0.095 AND l_quantity >= 45"

FIXTURES = {
    "fx_arcs": f"""SELECT p_partkey AS arc, {_arc_text("p_partkey")} AS arc_hash,
       CAST(floor(p_partkey / 50) AS BIGINT) AS segment_id,
       CAST(p_partkey % 50 AS BIGINT) AS seq, {ROAD} FROM {{part}}""",
    "fx_events": f"""SELECT l_partkey AS arc, l_suppkey AS trip_supplier, l_orderkey AS trip_id,
       {EVENT_TYPE} AS event_type, CAST(l_shipdate AS DATE) AS trip_date,
       l_returnflag AS weather, l_linestatus AS road_cycle,
       l_quantity AS sample_speed, l_extendedprice AS speed_change FROM {{lineitem}}""",
    # events of a type beside the six named ones as well
    "fx_seven_types": f"""SELECT l_partkey AS arc, CASE WHEN l_suppkey % 5 = 0
       THEN 'Seat Belt Event' ELSE {EVENT_TYPE} END AS event_type FROM {{lineitem}}""",
    # events that carry the attributes of their arc
    "fx_event_rows": f"""SELECT p_partkey AS arc, l_orderkey AS trip_id,
       {EVENT_TYPE} AS event_type, l_returnflag AS weather, l_linestatus AS road_cycle,
       l_quantity AS sample_speed, l_extendedprice AS speed_change, {ROAD},
       CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_name END AS circulation_poi,
       CASE WHEN p_partkey % 14 = 0 THEN NULL ELSE CAST(p_partkey % 37 AS DOUBLE) + 0.5 END AS tri,
       CAST(floor(p_partkey / 50) AS BIGINT) AS segment_id
       FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
    # events keyed by arc text, with the arc they end on and recorded endpoints
    "fx_text_events": f"""SELECT {_arc_text("l_partkey")} AS arc,
       {_arc_text("l_partkey + l_suppkey % 2")} AS end_arc,
       {EVENT_TYPE} AS event_type, l_returnflag AS weather,
       l_quantity AS sample_speed, l_linenumber * 10 + 20 AS speed_limit,
       48 + (l_partkey % 1000) / CAST(1000 AS DOUBLE) AS start_lat,
       -5 + (l_partkey % 777) / CAST(1000 AS DOUBLE) AS start_lng,
       48 + (l_suppkey % 10) / CAST(1000 AS DOUBLE) AS end_lat,
       -5 + (l_suppkey % 5) / CAST(1000 AS DOUBLE) AS end_lng FROM {{lineitem}}""",
    "fx_text_crashes": f"""SELECT {_arc_text("l_partkey")} AS arc FROM {{lineitem}}
       WHERE {CRASH_ROWS}""",
    # distances of arcs from 20 up, so that some arcs with events have none
    "fx_text_poi": f"""SELECT {_arc_text("p_partkey + 20")} AS arc,
       CASE WHEN p_partkey % 7 = 0 THEN -1 ELSE p_size * 40 END AS school,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size * 55 END AS hospital
       FROM {{part}}""",
    "fx_crashes": f"SELECT l_partkey AS arc FROM {{lineitem}} WHERE {CRASH_ROWS}",
    # some of these arcs lie beyond the last arc with events
    "fx_crashes_beyond": f"SELECT l_partkey + 60 AS arc FROM {{lineitem}} WHERE {CRASH_ROWS}",
    "fx_aadt": """SELECT p_partkey AS arc,
       CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_retailprice * 10 + p_size END AS aadt
       FROM {part}""",
    "fx_aadt_nan": """SELECT p_partkey AS arc, CASE WHEN p_partkey % 4 = 0 THEN NULL
       WHEN p_partkey % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE p_retailprice * 10 + p_size END AS aadt
       FROM {part}""",
    "fx_poi": """SELECT p_partkey AS arc,
       CASE WHEN p_partkey % 7 = 0 THEN -1 ELSE p_size * 40 END AS school,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size * 55 END AS hospital,
       CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE (p_size + 10) * 30 END AS park FROM {part}""",
    "fx_segments": """SELECT p_partkey AS arc, CAST(floor(p_partkey / 50) AS BIGINT) AS segment_id,
       CAST(p_partkey % 50 AS BIGINT) AS seq, p_retailprice AS distance_m,
       CAST(p_size % 4 AS BIGINT) AS crash_count FROM {part} WHERE p_partkey % 11 <> 0""",
    "fx_routes": """SELECT CAST(floor(o_custkey / 3) AS BIGINT) AS route,
       o_custkey % 3 AS itinerary_id,
       concat(CAST(CAST(floor(o_custkey / 3) AS BIGINT) AS STRING), '_',
              CAST(o_custkey % 3 AS STRING)) AS trip_id,
       l_partkey AS arc FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey""",
    # whole numbers, so that sums do not depend on the order of rows
    "fx_scores": """SELECT l_partkey AS arc, CAST(round(l_tax * 100) AS INT) * l_quantity AS prediction
       FROM {lineitem}""",
    "fx_scores_b": """SELECT l_partkey AS arc, l_linenumber * l_quantity AS prediction
       FROM {lineitem}""",
    "fx_trips": """SELECT l_orderkey AS trip_id, l_linenumber AS point_no, l_partkey AS arc,
       CAST(l_shipdate AS DATE) AS trip_date, n_name AS county,
       48 + (l_partkey % 1000) / CAST(1000 AS DOUBLE) AS lat,
       -5 + (l_suppkey % 1000) / CAST(1000 AS DOUBLE) AS lng
       FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey
       JOIN {nation} ON n_nationkey = s_nationkey""",
    "fx_labels": "SELECT doc_id, quality AS actual, toxic AS predicted FROM {labels}",
}


class Tables:
    """The given tables and the stand-ins of one data folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in FIXTURES:
            return read_table(self.spark, f"{self.folder}/{name}.parquet")
        text = FIXTURES[name]
        inputs = {n: self[n] for n in set(re.findall(r"\{(\w+)\}", text))}
        return self.spark.sql(text, **inputs)


def with_fixtures(sql: str) -> str:
    """Prefix a query with the stand-ins it names, as CTEs over the given tables."""
    used = [n for n in FIXTURES if re.search(rf"\b{n}\b", sql)]
    plain = {t: t for t in BASE_TABLES}
    ctes = [f"{n} AS ({FIXTURES[n].format(**plain)})" for n in used]
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
