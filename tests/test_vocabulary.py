"""Indexes of vocabularies of any size, and distributed row numbers."""

from __future__ import annotations

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from conftest import rows
from roadlens.catalog.fixtures import Tables
from roadlens.models import features as X
from roadlens.models.vocabulary import Vocabulary, fit_vocabulary, weighted_counts
from roadlens.operators.ranking import row_numbers
from roadlens.plans import crash_models

FOLDER = "/root/testdata/sf0.001"


def test_row_numbers_equal_a_window(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 3).alias("g"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("n"), F.col("id").alias("v")).repartition(6)
    got = row_numbers(df, "g", [F.col("n").desc(), F.col("v").asc()], "at")
    df.createOrReplaceTempView("numbered")
    want = spark.sql("SELECT *, CAST(row_number() OVER (PARTITION BY g ORDER BY n DESC, v) - 1 AS bigint) AS at FROM numbered")
    assert rows(got) == rows(want)
    assert row_numbers(df.limit(0), "g", [F.col("v").asc()]).count() == 0


def test_large_and_small_vocabularies_get_the_same_index(spark):
    """One category with a third of the rows, ties, nulls and names that look like numbers."""
    names = ["hot"] * 300 + [f"name {i % 211}" for i in range(500)] + [None] * 60 + ["7", "70", "x y"] * 3
    df = spark.createDataFrame([(i, n, i % 4) for i, n in enumerate(names)], "id int, name string, few int")
    named = X.fit_encoding(df, ["name", "few"]).transform(df)
    table = X.fit_encoding(df, ["name", "few"], limit=20)
    assert list(table.large.sizes) == ["name"]
    got = table.transform(df)
    assert got.columns == ["id", "name", "few", "name_index", "few_index", "name_encoded", "few_encoded"]
    columns = ["id", "name_index", "few_index", *[vector_to_array(c).alias(c) for c in ("name_encoded", "few_encoded")]]
    assert rows(got.select(*columns)) == rows(named.select(*columns))
    assert len(X.slot_names(got, "name_encoded")) == 215 and X.slot_names(got, "few_encoded")[0] == "0"
    unseen = spark.createDataFrame([(1, "new", 0), (2, "hot", 9)], df.schema)
    assert rows(table.transform(unseen).select("id", "name_index", "few_index")) == [(1, 215.0, 0.0), (2, 0.0, 4.0)]
    both = X.assemble_features(got, ["name_encoded", "few_encoded"])
    assert both.first()["features"].size == 215 + 4


def test_a_million_categories(spark):
    df = spark.range(1_100_000).select((F.col("id") % 1_000_000).alias("k"))
    found = fit_vocabulary(df, ["k"])
    assert found.sizes == {"k": 1_000_000} and found.hot == {"k": []}
    ranked = found.table.select(F.col("value"), "rank", "n")
    check = ranked.agg(F.min("rank"), F.max("rank"), F.countDistinct("rank"), F.max(F.when(F.col("n") == 2, F.col("rank"))))
    assert tuple(check.first()) == (0, 999_999, 1_000_000, 99_999)
    some = {r["value"]: r["rank"] for r in ranked.where("value IN ('0', '1', '100000', '999999')").collect()}
    twice, once = sorted(map(str, range(100_000))), sorted(map(str, range(100_000, 1_000_000)))
    assert some == {"0": 0, "1": twice.index("1"), "100000": 100_000 + once.index("100000"), "999999": 999_999}


def test_slots_of_many_categories_leave_no_names_in_the_driver(spark):
    """Metadata of a plan's columns is held in the driver, so no column may list its slots."""
    df = spark.createDataFrame([(0.0,), (99_998.0,), (99_999.0,), (100_000.0,)], "k_index double")
    hot = Vocabulary(None, {"k": 100_000}, {}).one_hot(df)
    assert len(hot._jdf.queryExecution().analyzed().schema().json()) < 2000
    assert "99998" not in hot._jdf.queryExecution().analyzed().child().schema().json()
    vectors = {r["k_index"]: r["k_encoded"] for r in hot.collect()}
    assert vectors == {i: SparseVector(100_000, [int(i)] if i < 100_000 else [], [1.0] if i < 100_000 else [])
                       for i in vectors} and len(vectors) == 4


def test_weights_order_the_categories(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.5), ("a", 1.0), ("c", 2.5), (None, 9.0)], "c string, w double")
    assert rows(fit_vocabulary(df, ["c"], "w").table.select("value", "rank")) == [("a", 2), ("b", 0), ("c", 1)]
    assert weighted_counts(df, []).count() == 0
    empty = fit_vocabulary(df.limit(0), ["c"])
    assert empty.sizes == {"c": 0} and rows(empty.index(df.limit(1)).select("c_index")) == [(0.0,)]


def test_crash_models_with_names_in_a_table(spark):
    tables = Tables(spark, FOLDER)
    events, crashes = tables["fx_event_rows"], tables["fx_crashes"]
    pairs = [crash_models.fit_crash_pair(events, crashes, ["weather", "road_cycle", "event_type"], limit=n)
             for n in (100_000, 2)]
    assert not pairs[0].indexing.large.sizes and "event_type" in pairs[1].indexing.large.sizes
    for model in ("count", "crash"):
        a, b = (getattr(p.models, model) for p in pairs)
        assert list(a.coefficients) == pytest.approx(list(b.coefficients), rel=1e-6, abs=1e-9)
