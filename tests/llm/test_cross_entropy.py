from __future__ import annotations

import math
import re
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens import session
from roadlens.llm import cross_entropy as ce
from roadlens.llm import storage


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_losses_against_brute_force(docs, texts, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic == 0}
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t)) for d, t in texts.items()}
    count = Counter(w for ws in words.values() for w in ws)
    known = {w for w, n in count.items() if n > 1}
    one, two = [Counter(), Counter()], [Counter(), Counter()]
    for d, ws in words.items():
        ws = [w if w in known else None for w in ws]
        for model in (0, 1) if d in good else (0,):
            one[model].update(ws)
            two[model].update(zip(["begin", *ws], ws))
    both = {p for p, n in two[0].items() if n > 1}
    scale = [sum(one[1].values()) / sum(one[0].values()), 1.0]
    size, history = len(known) + 2, [Counter(), Counter()]
    for model in (0, 1):
        for p in both:
            history[model][p[0]] += two[model][p] * scale[model]

    def loss(model, before, w):
        total = sum(one[model].values()) * scale[model]
        p = (one[model][w] * scale[model] + ce.PRIOR_WORD / size) / (total + ce.PRIOR_WORD)
        c = two[model][before, w] * scale[model] if (before, w) in both else 0.0
        return -math.log((c + ce.PRIOR_BIGRAM * p) / (history[model][before] + ce.PRIOR_BIGRAM))

    for r in ce.cross_entropy_difference(docs, labels).collect():
        ws = [w if w in known else None for w in words[r.doc_id]]
        assert r.n_tokens == len(ws)
        for model, found in ((0, r.background_loss), (1, r.target_loss)):
            expected = sum(loss(model, a, b) for a, b in zip(["begin", *ws], ws)) / len(ws)
            assert abs(found - expected) < 1e-6


def test_held_out_accuracy(larger, labels):
    rows = ce.cross_entropy_difference(larger, labels.filter("doc_id % 2 = 0")).collect()
    quality = {r.doc_id: r.quality for r in labels.filter("doc_id % 2 = 1").collect()}
    pairs = [(r.score, quality[r.doc_id]) for r in rows if r.doc_id in quality and r.score is not None]
    low = [s for s, q in pairs if q]
    high = [s for s, q in pairs if not q]
    better = np.mean([[a < b for b in high] for a in low])
    assert better > 0.9


def test_bounds_keep_the_most_frequent(docs, monkeypatch, spark):
    monkeypatch.setattr(ce, "VOCABULARY", 50)
    monkeypatch.setattr(ce, "BIGRAMS", 100)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    models = ce.train(ce.good_rows(docs.select("doc_id", "text"), labels), "good")
    assert 0 < len(models.vocabulary) <= 50 and 0 < len(models.pairs) <= 100


def test_odd_rows(spark, odd, empty, clashing):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, None), (5, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = ce.cross_entropy_difference(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all((r.score is None) == (r.n_tokens == 0) for r in rows)
    assert ce.cross_entropy_difference(empty, labels).count() == 0
    assert ce.cross_entropy_difference(clashing, labels.limit(0)).count() == len(rows)


def test_broadcast_terms_do_not_change_scores(docs, monkeypatch, spark):
    """What is broadcast is no bound of the models: nothing near, little near, all near."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    found = []
    for words, pairs in ((1 << 16, 1 << 19), (50, 100), (0, 0)):
        monkeypatch.setattr(ce, "VOCABULARY", words)
        monkeypatch.setattr(ce, "BIGRAMS", pairs)
        rows = ce.cross_entropy_difference(docs, labels).collect()
        found.append({r.doc_id: (r.n_tokens, r.target_loss, r.background_loss, r.score) for r in rows})
    for other in found[1:]:
        assert other.keys() == found[0].keys()
        for k, row in found[0].items():
            assert other[k] == pytest.approx(row, abs=1e-9)


def test_only_the_terms_stay(docs, spark):
    """What a step has written goes when no later step reads it."""
    session.clean(spark)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    models = ce.train(ce.good_rows(docs.select("doc_id", "text"), labels), "good")
    kept, = session._WRITTEN[spark.sparkContext.applicationId]
    assert "/terms-" in kept and models.terms.count() > 0


def test_slices_share_out_the_counts(docs, monkeypatch):
    """Each pass sends its part of the words and bigrams, and together they are all of them."""
    rows = docs.select("text", (F.col("doc_id") % 3 == 0).alias("good"))
    found = []
    for n in (1, 3):
        monkeypatch.setattr(ce, "SLICES", n)
        found.append([sorted(map(tuple, ce._counted(rows, 4, i).collect())) for i in range(n)])
    whole, parts = found[0][0], found[1]
    assert sorted(r for part in parts for r in part) == whole
    assert all(0.25 * len(whole) < len(part) < 0.42 * len(whole) for part in parts)


def test_shuffle_files_go_when_written(spark):
    def shuffled():
        manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f.name for d in manager.localDirs() for f in Path(d.getPath()).rglob("shuffle_*")}

    before, setting = shuffled(), spark.conf.get(storage.CLEANUP, "false")
    kept = storage.written_alone(spark.range(1000).repartition(3, "id"), "numbers")
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert kept.count() == 1000 and spark.conf.get(storage.CLEANUP, "false") == setting


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_bins_find_what_a_search_finds(n):
    """Also with many keys in one bin, and keys at both ends."""
    random = np.random.default_rng(n)
    near = random.integers(0, 200, n, dtype=np.uint64)
    keys = np.unique(np.concatenate([random.integers(0, (1 << 64) - 1, n, dtype=np.uint64), near]))
    if n > 1:
        keys = np.unique(np.append(keys, [np.uint64(0), np.uint64((1 << 64) - 1)]))
    wanted = np.concatenate([random.permutation(keys), random.integers(0, 300, 500, dtype=np.uint64), keys[:3] + np.uint64(1)])
    hit, at = ce._found_by_bins(keys, ce._bins(keys), wanted)
    expected, places = ce._found(keys, wanted)
    assert hit.tolist() == expected.tolist() and at.tolist() == places.tolist()
