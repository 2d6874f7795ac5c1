from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from roadlens.llm import jaccard_join as jj
from roadlens.llm.storage import written


def shingles(text, n):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = [(k, shingles(t, n)) for k, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least: dict = {}
    for i, (k, _) in enumerate(sets):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(s), least.get(find(i))) for i, (k, s) in enumerate(sets)), key=repr)


def agree(df, n=4, percent=85):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    found = sorted(((r.doc_id, r.n_shingles, r.component_id)
                    for r in jj.near_duplicates(df, shingle=n, percent=percent).collect()), key=repr)
    assert found == brute(rows, n, percent)


def test_documents(docs):
    agree(docs)


def near_copies(rng):
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for size in (3, 4, 5, 9, 12, 24, 25, 40, 110, 160):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(14):
            own = list(base)
            for _ in range(rng.randrange(4)):
                place = rng.randrange(len(own))
                own[place:place + 1] = rng.choice([[], [rng.choice(vocabulary)], [rng.choice(vocabulary)] * 2])
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("n,percent,largest", [(4, 85, 96), (4, 85, 2), (5, 80, 96), (1, 60, 96)])
def test_near_copies(spark, monkeypatch, n, percent, largest):
    monkeypatch.setattr(jj, "LARGEST_SMALL", largest)
    rows = near_copies(random.Random(n * percent))
    agree(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), n, percent)


def test_lists_and_subsets_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame(near_copies(random.Random(8)), "doc_id long, text string")
    for x in (2, 30, 97):
        monkeypatch.setattr(jj, "boundary", lambda sets, percent, x=x: x)
        agree(df)


def test_odd_rows(odd, empty, clashing):
    agree(odd.filter("doc_id IS NOT NULL"))
    assert jj.near_duplicates(odd).count() == odd.count()
    assert jj.near_duplicates(empty).count() == 0
    assert jj.near_duplicates(clashing).count() == odd.count()


def test_templates_are_not_paired(spark):
    """Pages of one template and few own words share a bucket and cannot link."""
    template = " ".join(f"template{i}" for i in range(20))
    rows = [(i, f"{template} own{i} word{i} last{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = jj.shared_shingles(df, "text").groupBy("class", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    sets = sets.withColumn("first", F.lit(4)).withColumn("central", F.lit(1.0))
    assert sets.count() == 2000 and jj.meetings(sets, jj.PERCENT).count() == 0
    assert {r.component_id == r.doc_id for r in jj.near_duplicates(df).collect()} == {True}


@pytest.mark.parametrize("block", [1, 3, 2000])
def test_rest_compares_every_pair_once(spark, block):
    rng = random.Random(block)
    members = [(b, c) for b in range(4) for c in rng.sample(range(60), 25)]
    rows = spark.createDataFrame([(b, c, 10, 10, c % 9) for b, c in members],
                                 "bucket long, class long, n long, most long, component long")
    sets = spark.createDataFrame([(c, 10, [(2, t + c % 2) for t in range(10)]) for c in range(60)],
                                 "class long, n long, shared array<struct<df:long,token:long>>")
    got = sorted(tuple(r) for r in jj._rest(rows, sets, 85, block).collect())
    want = sorted({(a, b) for x, a in members for y, b in members
                   if x == y and a < b and a % 9 != b % 9 and (a - b) % 2 == 0})
    assert got == want


@pytest.mark.parametrize("bits", [4, 9, 16, 20])
def test_ranges_do_not_change_what_is_shared(spark, bits):
    rng = random.Random(bits)
    words = [f"w{i}" for i in range(40)]
    df = spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(60)),) for _ in range(60)], "text string")
    plain = jj.shared_shingles(df, "text", 2).groupBy("class", "n").agg(F.sort_array(F.collect_list("df")))
    other = jj.shared_shingles(df, "text", 2, bits).groupBy("class", "n").agg(F.sort_array(F.collect_list("df")))
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, other.collect())) and plain.count() > 50


def test_shared_shingles_are_dealt_as_plain_rows(docs, monkeypatch):
    """Lists begun before the exchange get shorter, and so larger by row, with more tasks."""
    plans = {}

    def recorded(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name)

    monkeypatch.setattr(jj, "written", recorded)
    jj.near_duplicates(docs)
    plan = plans["sets"]
    assert plan.index("partial_collect_list") < plan.index("Exchange hashpartitioning(class")


def test_slices_of_a_range_hold_all_of_it(docs, monkeypatch):
    found = []
    for slices in (1, 4, 7):
        monkeypatch.setattr(jj, "SLICES", slices)
        found.append(sorted(map(tuple, jj.shared_shingles(docs, "text").collect())))
    assert found[0] and found[0] == found[1] == found[2]
