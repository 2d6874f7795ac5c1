"""Category indexes of any number of categories: the names stay in a table.

Categories are numbered as a string indexer numbers them, the most frequent first and equals
in text order, but by ranges of a distributed sort, and rows get their number by a join.
One-hot slots are sparse vectors that know their size and no names."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from roadlens.operators.joins import shuffle_partitions, spread_join
from roadlens.operators.ranking import row_numbers
from roadlens.session import materialize

INDEX, ENCODED = "_index", "_encoded"


def weighted_counts(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """(name, value, n) of every category of every column, in one pass; nulls are none.
    ``n`` is the number of rows, or the sum of ``weight``."""
    n = F.lit(1) if weight is None else F.col(weight)
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])
    if not columns:
        pairs = pairs.cast("array<struct<name:string,value:string>>")
    rows = df.select(n.alias("_n"), F.inline(pairs))
    return rows.where("value IS NOT NULL").groupBy("name", "value").agg(F.sum("_n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """``table`` holds (name, value, n, rank) and ``sizes`` the categories per column; ``hot``
    lists per column the hashes of categories with more than an even share of the rows, and
    how many shares each has."""

    table: DataFrame | None
    sizes: dict[str, int]
    hot: dict[str, list[tuple[int, int]]]

    def index(self, df: DataFrame) -> DataFrame:
        """``df`` with ``<column>_index``: the category's rank, and for null and unknown ones
        the number of categories."""
        for column, size in self.sizes.items():
            names = df.columns
            known = self.table.where(F.col("name") == column).select(
                F.col("value").alias("_value"), F.col("rank").cast("double").alias("_rank"))
            valued = df.withColumn("_value", F.col(column).cast("string"))
            joined = spread_join(valued, known, "_value", "left", self.hot[column])
            rank = F.coalesce("_rank", F.lit(float(size))).alias(column + INDEX)
            df = joined.select(*names, rank)
        return df

    def one_hot(self, df: DataFrame) -> DataFrame:
        """``df`` with sparse ``<column>_encoded`` of as many slots as categories; null and
        unknown ones have none set.

        The vectors are read from JSON in the executors: Spark ML's encoder lists an attribute
        of every slot in the driver."""
        return df.withColumns({c + ENCODED: _slot(F.col(c + INDEX), size).alias(
            c + ENCODED, metadata={"ml_attr": {"num_attrs": size}}) for c, size in self.sizes.items()})


def _slot(index: Column, size: int) -> Column:
    """A sparse vector of ``size`` slots with the slot of ``index`` set, if there is one."""
    indices, values = (F.when(index < size, x).otherwise("") for x in (index.cast("int").cast("string"), F.lit("1.0")))
    text = F.concat(F.lit(f'{{"v":{{"type":0,"size":{size},"indices":['), indices, F.lit('],"values":['),
                    values, F.lit("]}}"))
    return F.from_json(text, StructType([StructField("v", VectorUDT())]))["v"]


def fit_vocabulary(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> Vocabulary:
    """The categories of some columns, numbered. The driver gets one size per column and
    fewer hot categories than there are shuffle partitions, no names."""
    if not columns:
        return Vocabulary(None, {}, {})
    counts = weighted_counts(df, columns, weight)
    table = materialize(row_numbers(counts, "name", [F.col("n").desc(), F.col("value").asc()]))
    totals = {r["name"]: r for r in table.groupBy("name").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("rows")).collect()}
    parts = shuffle_partitions(df)
    hot: dict[str, list[tuple[int, int]]] = {c: [] for c in columns}
    share = F.create_map(*[x for c, r in totals.items() for x in (F.lit(c), F.lit(float(r["rows"]) / parts))])
    if totals:
        busy = table.where(F.col("n") > share[F.col("name")])
        for row in busy.select("name", F.xxhash64("value").alias("key"), "n").collect():
            hot[row["name"]].append((row["key"], math.ceil(row["n"] * parts / float(totals[row["name"]]["rows"]))))
    return Vocabulary(table, {c: totals[c]["size"] if c in totals else 0 for c in columns}, hot)
