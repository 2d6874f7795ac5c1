"""Medians and quantiles: a bounded sketch by default, exact on request."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.functions.columns import not_nan
from roadlens.operators.ranking import running_totals
from roadlens.session import materialize

ACCURACY = 10000
SKETCH_SIZE = 4096  # its ranks are right within 0.0013 of the rows with a confidence of 0.99
MARGIN = 0.004
COLLECTED = 1 << 17  # counts that may go to the driver


def _values(df: DataFrame, column: str) -> Column:
    value = F.col(column).cast("double")
    return not_nan(value)


def approx_median(df: DataFrame, column: str) -> Column:
    return F.percentile_approx(_values(df, column), 0.5, ACCURACY)


def approx_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]):
    """All columns in one aggregate; one row of arrays, one array per column."""
    return df.agg(
        *[F.percentile_approx(_values(df, c), list(probabilities), ACCURACY).alias(c)
          for c in columns]
    )


def quantile_sketch(value: Column | str) -> Column:
    """A mergeable sketch (KLL) of a numeric value, as an aggregate. Nulls are left out."""
    return F.kll_sketch_agg_double(value, SKETCH_SIZE)


def bracket(sketch: Column, share: float) -> Column:
    """Two values that very probably enclose the value at a share of the sketched ones, as an
    array; null for a null sketch. A sketch of no values has no bracket."""
    around = [max(0.0, share - MARGIN), min(1.0, share + MARGIN)]
    return F.when(sketch.isNotNull(), F.kll_sketch_get_quantile_double(sketch, F.array(*map(F.lit, around))))


def bracket_of(df: DataFrame, sketch: bytes, share: float) -> tuple[float, float]:
    """The bracket of a sketch that the driver holds, by a local frame; no job reads ``df``."""
    local = df.sparkSession.createDataFrame([(bytearray(sketch),)], "s binary")
    return tuple(local.select(bracket(F.col("s"), share)).first()[0])


def counts_in(df: DataFrame, ranges: Sequence[tuple[Column, float, float]]) -> DataFrame:
    """(at, v, n): for the range number ``at`` how many values equal ``v``, and with a null
    ``v`` how many lie below the range. One aggregate for all ranges."""
    spots = F.array(*[
        F.struct(F.lit(i).alias("at"), F.when(value >= low, value).alias("v"), (value <= high).alias("near"))
        for i, (value, low, high) in enumerate(ranges)])
    near = df.select(F.inline(F.filter(spots, lambda s: s["near"])))
    return near.groupBy("at", "v").agg(F.count(F.lit(1)).alias("n"))


def values_at(counts: DataFrame, ranks: Sequence[tuple[int, int]], bound: int) -> list[tuple[float, int] | None]:
    """For pairs of range number and rank (from 0) the value that holds the rank and the rows
    before that value; None where it lies outside the range.

    Up to ``COLLECTED`` counts, as ``bound`` must guarantee, go to the driver; more are summed up
    by ranges of a distributed sort, of which only the rows asked for return."""
    if bound <= COLLECTED:
        by_range: dict[int, list] = {}
        for row in counts.collect():
            by_range.setdefault(row["at"], []).append((row["v"] is not None, row["v"] or 0.0, row["n"]))
        return [_walk(sorted(by_range.get(at, [])), rank) for at, rank in ranks]
    totals = running_totals(counts, "at", [F.col("v").asc_nulls_first()], "n", "before")
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(at).alias("range"), F.lit(rank).alias("rank"))
                       for i, (at, rank) in enumerate(ranks)])
    hit = totals.select("*", F.inline(wanted)).where(
        (F.col("at") == F.col("range")) & F.col("rank").between(F.col("before"), F.col("before") + F.col("n") - 1))
    found = {r["i"]: (r["v"], r["before"]) for r in hit.collect()}
    return [found.get(i) if found.get(i, (None,))[0] is not None else None for i in range(len(ranks))]


def _walk(counts: list[tuple[bool, float, int]], rank: int) -> tuple[float, int] | None:
    before = 0
    for inside, value, n in counts:
        if rank < before + n:
            return (value, before) if inside else None
        before += n
    return None


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles of the non-null, non-NaN values per column.

    The frame is read twice, whatever the data: one aggregate sketches all columns, which
    encloses every wanted rank between two values; the other counts the values in between and
    those below. Should a rank lie outside, which is very rare, the second is done again
    over all values."""
    value = {c: _values(df, c) for c in columns}
    sketched = df.agg(*[agg for i, c in enumerate(columns) for agg in (
        F.count(value[c]).alias(f"n{i}"), quantile_sketch(value[c]).alias(f"s{i}"))])
    stats = sketched.select(*[x for i in range(len(columns)) for x in (
        f"n{i}", F.array(*[
            bracket(F.when(F.col(f"n{i}") > 0, F.col(f"s{i}")), p) for p in probabilities]).alias(f"b{i}"))]).first()
    places = {(i, p): (stats[f"n{i}"] - 1) * p for i in range(len(columns)) if stats[f"n{i}"] for p in probabilities}
    found: dict[tuple[int, int], float] = {}
    if places:
        around = [tuple(stats[f"b{i}"][probabilities.index(p)]) for i, p in places]
        ranks = [(at, rank) for at, place in enumerate(places.values())
                 for rank in dict.fromkeys((math.floor(place), math.ceil(place)))]
        column = [i for i, _ in places]
        for tries in (around, [(-math.inf, math.inf)] * len(around)):
            left = [r for r in ranks if (column[r[0]], r[1]) not in found]
            if left:
                ranges = [(value[columns[i]], *b) for i, b in zip(column, tries, strict=True)]
                counts, bound = counts_in(df, ranges), sum(stats[f"n{i}"] for i in column)
                counts = materialize(counts) if bound > COLLECTED else counts
                for (at, rank), hit in zip(left, values_at(counts, left, bound), strict=True):
                    if hit is not None:
                        found[column[at], rank] = hit[0]
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        out[c] = [None] * len(probabilities)
        for j, p in enumerate(probabilities):
            if (i, p) in places:
                place = places[i, p]
                a, b = found[i, math.floor(place)], found[i, math.ceil(place)]
                out[c][j] = a if a == b else a + (b - a) * (place - math.floor(place))
    return out
