"""Packed arc keys: ``<lon9><lat9>_<lon9><lat9>``, each part ``(degrees + 500) * 1e6``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadlens.functions.columns import _col

# fixed values of the key format
COORDINATE_DIGITS = 9
COORDINATE_SCALE = 1000000
COORDINATE_SHIFT = 500


def split_part(column: Column | str, separator: str, index: int) -> Column:
    """Zero-based part of a split text; null when there is no such part."""
    return F.get(F.split(_col(column), separator), index)


def substring_int(column: Column | str, start: int, length: int) -> Column:
    """Fixed-position digits as int; null when they are not a number."""
    return F.substring(_col(column), start, length).try_cast("int")


def decode_coordinate(column: Column | str) -> Column:
    return _col(column) / F.lit(COORDINATE_SCALE) - F.lit(COORDINATE_SHIFT)


def decode_arc(column: Column | str) -> dict[str, Column]:
    """The four coordinates of an arc key as named columns."""
    out = {}
    for index, end in enumerate(("start", "end")):
        point = split_part(column, "_", index)
        for place, axis in enumerate(("lon", "lat")):
            digits = substring_int(point, 1 + place * COORDINATE_DIGITS, COORDINATE_DIGITS)
            out[f"{end}_{axis}"] = decode_coordinate(digits)
    return out


def wkt_linestring(
    start_lon: Column | str, start_lat: Column | str, end_lon: Column | str, end_lat: Column | str
) -> Column:
    """Two points as WKT with six decimals; null when a coordinate is missing."""
    points = [_col(c).cast("double") for c in (start_lon, start_lat, end_lon, end_lat)]
    complete = points[0].isNotNull()
    for p in points[1:]:
        complete = complete & p.isNotNull()
    return F.when(complete, F.format_string("LINESTRING(%.6f %.6f,%.6f %.6f)", *points))
