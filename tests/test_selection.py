"""Selection over numbers and categories against numpy."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.models import selection as N


def statistic(values, labels):
    total, n = 0.0, len(labels)
    for v in set(values):
        for y in set(labels):
            seen = sum(a == v and b == y for a, b in zip(values, labels))
            expected = values.count(v) * labels.count(y) / n
            total += (seen - expected) ** 2 / expected
    return total


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    out = []
    for i in range(600):
        y = rng.choice([0, 1, 2])
        out.append((y + rng.random() * 2 if rng.random() < 0.9 else None, rng.random(), float("nan") if i % 50 == 0 else float(i % 3),
                    rng.choice("abc") if y else rng.choice("aad"), rng.choice(["x", None]), y if rng.random() < 0.97 else None))
    return out


def test_scores_against_whole_tables(spark, data):
    df = spark.createDataFrame(data, "p double, q double, k double, c string, d string, y int").repartition(4)
    edges = N.bin_edges(df, ["p", "q", "k"])
    assert edges["k"] == [0.0, 1.0, 2.0] and len(edges["q"]) == 9
    got = {r["slot"]: r for r in N.slot_scores(
        N.contingency(df, edges, ["c", "d"], "y"), ["p", "q", "k"], ["c", "d"]).collect()}
    assert set(got) == {"p", "q", "k", "c=a", "c=b", "c=c", "c=d", "d=x"}
    known = [r for r in data if r[5] is not None]
    labels = [r[5] for r in known]
    for i, name in enumerate(("p", "q", "k")):
        bins = [None if r[i] is None or np.isnan(r[i]) else sum(e < r[i] for e in edges[name]) for r in known]
        assert got[name]["statistic"] == pytest.approx(statistic(bins, labels), rel=1e-9)
        assert got[name]["degrees"] == (len(set(bins)) - 1) * 2
    for slot in ("c=a", "c=b", "c=c", "c=d", "d=x"):
        at = 3 if slot[0] == "c" else 4
        assert got[slot]["statistic"] == pytest.approx(statistic([r[at] == slot[2:] for r in known], labels), rel=1e-9)
        assert got[slot]["degrees"] == 2
    best = [r["slot"] for r in N.select_slots(df, ["p", "q", "k"], ["c", "d"], "y", 2).collect()]
    assert best[0] == "p" and best[1] == "c=d"


def test_score_follows_the_p_value(spark):
    """Equal p-values of different degrees get nearly equal scores (quantiles of chi-square at 0.95 and 0.999)."""
    rows = [("a", 3.841, 1), ("b", 5.991, 2), ("c", 18.307, 10), ("d", 10.828, 1), ("e", 29.588, 10)]
    df = spark.createDataFrame(rows, "slot string, statistic double, degrees int")
    k, part = F.col("degrees").cast("double"), F.lit(2.0) / (F.lit(9.0) * F.col("degrees"))
    got = [r[0] for r in df.select((F.cbrt(F.col("statistic") / k) - (1 - part)) / F.sqrt(part)).collect()]
    assert np.allclose(got[:3], 1.645, atol=0.05) and np.allclose(got[3:], 3.09, atol=0.15)


def test_nothing_to_tell(spark):
    df = spark.createDataFrame([(1.0, "a", 1), (1.0, "a", 0), (None, None, None)], "p double, c string, y int")
    assert N.select_slots(df, ["p"], ["c"], "y").count() == 0
    assert N.select_slots(df.limit(0), ["p"], ["c"], "y").count() == 0
