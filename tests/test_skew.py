"""Hot keys, exact samples, exact quantiles and range joins against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from roadlens.operators import joins as J
from roadlens.operators.quantiles import exact_quantiles
from roadlens.operators.sampling import (
    limit_ratio, repeat_rows, split_train_test, take_by_hash, with_split,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows on key 1, a third without key, the rest spread; many equal."""
    data = [(1, i % 3) for i in range(3000)] + [(None, i % 3) for i in range(3000)]
    data += [(2 + i % 50, i) for i in range(3000)]
    left = spark.createDataFrame(data, "k int, v int").repartition(6)
    right = spark.createDataFrame([(k, k * 10) for k in range(0, 40)], "k int, w int")
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(skewed, how):
    left, right = skewed
    assert rows(J.spread_join(left, right, "k", how)) == rows(left.join(right, "k", how))


def test_spread_join_of_repeated_right_rows(skewed):
    left, right = skewed
    twice = right.unionAll(right)
    assert rows(J.spread_join(left, twice, ["k"])) == rows(left.join(twice, "k"))


def test_hot_keys_are_few_and_found(spark, skewed):
    left, _ = skewed
    names = {r["h"]: r["k"] for r in left.select("k", F.xxhash64("k").alias("h")).collect()}
    assert {names[h]: n for h, n in J.hot_keys(left, "k", 8)} == {1: 3, None: 3}
    assert len(J.hot_keys(left, "k", 1000)) < 1000
    assert J.hot_keys(left.limit(0), "k") == []


def test_every_hot_key_is_found_among_many(spark):
    """Forty keys just above an even share, under a million rows of other keys."""
    hot = spark.range(40).select(F.explode(F.array_repeat(F.col("id"), 22_000)).alias("k"))
    rest = spark.range(1_000_000).select((F.col("id") + 100).alias("k"))
    found = J.hot_keys(hot.unionAll(rest).repartition(8), "k", 100)
    assert len(found) == 40 and {n for _, n in found} == {2}


def test_spread_join_across_key_types(spark):
    left = spark.createDataFrame([(1,)] * 50 + [(2,)], "k bigint")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, w string")
    assert J.spread_join(left, right, "k").count() == 51
    assert J.spread_join(right, left.withColumn("v", F.lit(0)), "k").count() == 51


def test_spread_join_on_two_keys(spark):
    left = spark.createDataFrame([(1, "x")] * 60 + [(1, "y"), (2, None)], "a int, b string")
    right = spark.createDataFrame([(1, "x", 5), (1, "y", 6), (2, None, 7)], "a int, b string, w int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = J.spread_join(left, right, ["a", "b"], how)
        assert rows(got) == rows(left.join(right, ["a", "b"], how))


def test_hot_key_rows_reach_several_tasks(spark, skewed):
    left, right = skewed
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = J.spread_join(left, right, "k", "left")
        tasks = joined.select(F.spark_partition_id().alias("p"), "k").groupBy("k").agg(
            F.countDistinct("p").alias("tasks"))
        found = {r["k"]: r["tasks"] for r in tasks.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert found[1] >= 2 and found[None] >= 3 and found[5] == 1


def test_no_hot_key_gives_a_plain_join(spark):
    left = spark.range(1000).withColumnRenamed("id", "k")
    joined = J.spread_join(left, left.withColumn("w", F.col("k")), "k")
    assert "_salt" not in joined._jdf.queryExecution().toString()


def test_join_back_count(skewed):
    left, _ = skewed
    got = J.join_back_count(left, "k", "n")
    assert got.where("k = 1").select("n").distinct().collect()[0]["n"] == 3000
    assert got.count() == 6000


@pytest.mark.parametrize("size", [0, 17, 999, 5000])
def test_take_by_hash_is_exact(spark, size):
    df = spark.range(1000).withColumnRenamed("id", "arc").repartition(5)
    got = [r["arc"] for r in take_by_hash(df, F.lit(size), ["arc"]).collect()]
    assert len(got) == min(size, 1000) == len(set(got))
    again = [r["arc"] for r in take_by_hash(df.repartition(3), F.lit(size), ["arc"]).collect()]
    assert sorted(got) == sorted(again)


@pytest.mark.parametrize("narrow", [{"MARGIN": 0.0}, {"COLLECTED": 0}, {"MARGIN": 0.0, "SKETCH_SIZE": 8}])
def test_take_by_hash_does_not_depend_on_the_sketch(spark, monkeypatch, narrow):
    """Neither a bracket that is too narrow nor counts that stay distributed change the sample."""
    df = spark.range(1000).withColumnRenamed("id", "arc")
    plain = {r["arc"] for r in take_by_hash(df, F.lit(333), ["arc"]).collect()}
    for name, value in narrow.items():
        monkeypatch.setattr(f"roadlens.operators.quantiles.{name}", value)
    assert plain == {r["arc"] for r in take_by_hash(df, F.lit(333), ["arc"]).collect()} and len(plain) == 333


def test_sample_is_the_head_of_the_hash_order(spark):
    from roadlens.functions.columns import hash_number
    df = spark.range(3000).select((F.col("id") % 40).alias("arc"), F.col("id").alias("v"))
    got = {r["v"] for r in take_by_hash(df, F.lit(700), ["arc"]).collect()}
    ordered = df.orderBy(hash_number(42, "arc"), hash_number(42, "arc", "v"), "arc", "v")
    assert got == {r["v"] for r in ordered.limit(700).collect()}


def test_limit_ratio_reads_its_rows_twice(spark):
    """One aggregate, and one pass that writes little more than the sample."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(20_000).select("id", F.when(F.col("id") % 100 == 0, 1).otherwise(0).alias("crash"))
    watched = df.mapInArrow(counted, df.schema)
    got = limit_ratio(watched, "crash", ["id"], 4, positives=True)
    assert rows(got.groupBy("crash").count()) == [(0, 800), (1, 200)]
    assert seen.value == 2 * 20_000


@pytest.mark.parametrize("size", [400, 25_000, 60_000])
def test_take_by_hash_counts_copies(spark, size):
    """Two rows in three are copies of one row."""
    df = spark.range(30_000).select(F.when(F.col("id") < 20_000, 7).otherwise(F.col("id"))
                                    .alias("arc"), F.lit("x").alias("s"))
    got = take_by_hash(df, F.lit(size), ["arc"]).groupBy("arc").count().collect()
    assert sum(r["count"] for r in got) == min(size, 30_000)
    found = {r["arc"]: r["count"] for r in got}
    assert found.pop(7, 0) <= 20_000 and set(found.values()) <= {1}


def test_null_keys_are_split_and_sampled(spark):
    df = spark.createDataFrame([(None,)] * 5 + [(i,) for i in range(20)], "arc int")
    train, test = split_train_test(df, ["arc"])
    assert train.count() + test.count() == 25
    assert take_by_hash(df, F.lit(25), ["arc"]).count() == 25
    assert take_by_hash(df, F.lit(24), ["arc"]).count() == 24


def test_repeat_rows(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 10_000), ("d", 25_001)], "k string, n int")
    got = {r["k"]: r["count"] for r in repeat_rows(df, "n").groupBy("k").count().collect()}
    assert got == {"b": 1, "c": 10_000, "d": 25_001}


def test_split_does_not_depend_on_partitioning(spark):
    df = spark.range(5000).withColumnRenamed("id", "arc")
    a, b = with_split(df, ["arc"]), with_split(df.repartition(7), ["arc"])
    assert rows(a) == rows(b)
    share = a.where("split = 'train'").count() / 5000
    assert 0.77 < share < 0.83


@pytest.mark.parametrize("kind", ["uniform", "lumpy", "wide", "equal", "infinite", "neighbours"])
@pytest.mark.parametrize("narrow", [{}, {"MARGIN": 0.0, "SKETCH_SIZE": 8}, {"COLLECTED": 0}])
def test_exact_quantiles(spark, monkeypatch, kind, narrow):
    for name, changed in narrow.items():
        monkeypatch.setattr(f"roadlens.operators.quantiles.{name}", changed)
    rng = np.random.default_rng(7)
    values = {
        "uniform": rng.random(4000),
        "lumpy": np.concatenate([np.full(3000, 5.0), rng.normal(5, 1e-6, 1000)]),
        "wide": np.concatenate([rng.normal(0, 1, 2000), rng.normal(0, 1e12, 2000), [-1e300, 1e300]]),
        "equal": np.full(100, -3.25),
        "infinite": np.concatenate([np.full(30, -np.inf), rng.random(50), np.full(20, np.inf)]),
        "neighbours": np.array([1.0, np.nextafter(1.0, 2.0), np.nextafter(1.0, 2.0), 5e-324, 0.0, -5e-324]),
    }[kind]
    levels = [0.0, 0.5, 0.75]
    data = [(float(v),) for v in values] + [(None,), (float("nan"),)]
    df = spark.createDataFrame(data, "v double").cache()
    ordered = np.sort(values)
    expected = []
    for p in levels:
        at = (len(ordered) - 1) * p
        a, b = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
        expected.append(float(a if a == b else a + (b - a) * (at - np.floor(at))))
    got = exact_quantiles(df, ["v"], levels)["v"]
    assert got == pytest.approx(expected, rel=1e-12, nan_ok=True)
    df.unpersist()


def test_join_range_against_brute_force(spark):
    rng = random.Random(3)
    master = [(s, q, f"{s}-{q}") for s in range(4) for q in range(0, 300, rng.choice([1, 2, 3]))]
    ranges = []
    for trip in range(200):
        s = 0 if trip % 3 else rng.randrange(5)
        lo, hi = sorted((rng.randrange(300), rng.randrange(300)))
        ranges.append((f"t{trip}", s, lo, hi))
    expected = sorted((t, a) for t, s, lo, hi in ranges for ms, q, a in master
                      if ms == s and lo <= q <= hi)
    left = spark.createDataFrame(ranges, "trip string, segment int, lo int, hi int")
    right = spark.createDataFrame(master, "segment int, seq int, arc string")
    for width in (16, 1000):
        got = J.join_range(left, right, "segment", "seq", width=width)
        assert sorted(tuple(r) for r in got.select("trip", "arc").collect()) == expected
        assert got.columns == ["trip", "segment", "lo", "hi", "seq", "arc"]


def test_range_join_meets_cells_and_splits_crowded_ones(spark):
    """A third of the master on one position; joined rows are the arrays of touched cells."""
    master = [(1, 7, i) for i in range(1000)] + [(1, i % 640, 1000 + i) for i in range(2000)] + [(1, None, -1), (None, 3, -2)]
    right = spark.createDataFrame(master, "segment int, seq int, v int").repartition(5)
    packed = J.packed_cells(right, ["segment"], "seq", 64, rows=50)
    sizes = [r["n"] for r in packed.select(F.size("_rows").alias("n")).collect()]
    assert sum(sizes) == len(master) - 1 and max(sizes) < 150
    plain = J.packed_cells(right.where("segment = 1"), ["segment"], "seq", 64)
    assert plain.count() == 10
    left = spark.createDataFrame([("a", 1, 0, 639), ("b", 1, 7, 7), ("c", 1, 60, 70), ("d", 2, 0, 9), ("e", None, 0, 9)],
                                 "trip string, segment int, lo int, hi int")
    got = J.join_range(left, right, "segment", "seq")
    want = [(t, v) for t, s, lo, hi in left.collect() for ms, q, v in master
            if s is not None and s == ms and q is not None and lo <= q <= hi]
    assert rows(got.select("trip", "v")) == sorted(want, key=repr)


@pytest.mark.parametrize("parts", [1, 12])
def test_samples_of_rows_whose_keys_repeat(spark, parts):
    one = spark.createDataFrame([("k", i) for i in range(100)], "k string, v int").repartition(parts)
    first = {r["v"] for r in take_by_hash(one, F.lit(30), ["k"]).collect()}
    assert len(first) == 30
    again = {r["v"] for r in take_by_hash(one.repartition(5), F.lit(30), ["k"]).collect()}
    assert first == again
    ten = spark.createDataFrame([(f"k{i % 10}", i // 3) for i in range(1000)], "k string, v int")
    assert take_by_hash(ten.repartition(parts), F.lit(250), ["k"]).count() == 250
    assert take_by_hash(ten, F.lit(5000), ["k"]).count() == 1000
    assert take_by_hash(ten, F.lit(0), ["k"]).count() == 0


def test_join_range_evaluates_its_ranges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    ranges = spark.createDataFrame([(i, i % 3, 0, 40) for i in range(60)], "trip int, segment int, lo int, hi int")
    master = spark.createDataFrame([(s, q) for s in range(3) for q in range(50)], "segment int, seq int")
    got = J.join_range(ranges.mapInArrow(counted, ranges.schema), master, "segment", "seq", width=8)
    assert got.count() == 60 * 41
    assert seen.value == 60
