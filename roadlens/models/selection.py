"""Choosing slots of a mixed vector, numbers and encoded categories, by chi-square tests.

Numbers are cut into bins at exact quantiles. One aggregate counts all contingency tables, of
every number's bins and of every category, against the label; the statistics follow from those
counts, which are as many as there are bins and categories, whatever the rows. Nothing is
assembled into vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.operators.quantiles import exact_quantiles

BINS = 10


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Distinct inner borders of ``bins`` bins of about equal counts."""
    if not columns:
        return {}
    found = exact_quantiles(df, columns, [i / bins for i in range(1, bins)])
    return {c: sorted({e for e in edges if e is not None}) for c, edges in found.items()}


def bin_of(column: str, edges: Sequence[float]) -> Column:
    """Number of borders below the value; null for a missing one."""
    value = F.col(column).cast("double")
    below = [F.when(value > e, 1).otherwise(0) for e in map(float, edges)]
    return F.when(value.isNotNull() & ~F.isnan(value), sum(below, F.lit(0)))


def contingency(
    df: DataFrame, edges: Mapping[str, Sequence[float]], categories: Sequence[str], label: str
) -> DataFrame:
    """(name, value, label, n) of every number's bins and every category, in one aggregate.
    A missing value is a value of its own, null; rows without a label are left out."""
    values = {c: bin_of(c, e) for c, e in edges.items()} | {c: F.col(c) for c in categories}
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), v.cast("string").alias("value")) for c, v in values.items()])
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.inline(pairs))
    return rows.groupBy("name", "value", "label").agg(F.count(F.lit(1)).alias("n"))


def slot_scores(counts: DataFrame, numbers: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """(slot, statistic, degrees, score) of every number and every category's slot.

    A number is tested over all of its bins, a slot by whether it is set. ``score`` makes tests of
    different degrees of freedom comparable: it rises as the p-value falls (a normal deviate,
    by the cube root), also where p-values are too small to tell apart."""
    one = (*numbers, *categories)[0]
    labels = counts.where(F.col("name") == one).groupBy("label").agg(F.sum("n").alias("c"))
    total = labels.agg(F.sum("c").cast("double").alias("N"), F.count(F.lit(1)).alias("L"))
    per_value = counts.join(F.broadcast(labels), "label").groupBy("name", "value").agg(
        F.sum("n").cast("double").alias("r"), F.sum(F.col("n") * F.col("n") / F.col("c")).alias("s")
    ).join(F.broadcast(total))
    whole = per_value.where(F.col("name").isin(*numbers)).groupBy("name").agg(
        (F.max("N") * F.sum(F.col("s") / F.col("r")) - F.max("N")).alias("statistic"),
        ((F.count(F.lit(1)) - 1) * (F.max("L") - 1)).alias("degrees"),
    ).select(F.col("name").alias("slot"), "statistic", "degrees")
    r, n = F.col("r"), F.col("N")
    single = per_value.where(F.col("name").isin(*categories) & F.col("value").isNotNull() & (r < n)).select(
        F.concat_ws("=", "name", "value").alias("slot"),
        ((F.col("s") - r * r / n) * n * n / (r * (n - r))).alias("statistic"), (F.col("L") - 1).alias("degrees"))
    k, part = F.col("degrees").cast("double"), F.lit(2.0) / (F.lit(9.0) * F.col("degrees").cast("double"))
    score = (F.cbrt(F.greatest("statistic", F.lit(0.0)) / k) - (F.lit(1.0) - part)) / F.sqrt(part)
    return whole.unionByName(single).where("degrees > 0").withColumn("score", score)


def select_slots(
    df: DataFrame, numbers: Sequence[str], categories: Sequence[str], label: str, top: int = 10, bins: int = BINS
) -> DataFrame:
    """The ``top`` slots by ``score``, equals by name."""
    counts = contingency(df, bin_edges(df, numbers, bins), categories, label)
    return slot_scores(counts, numbers, categories).orderBy(F.col("score").desc(), "slot").limit(top)
