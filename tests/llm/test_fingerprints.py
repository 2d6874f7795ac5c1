from __future__ import annotations

import hashlib
import re
import statistics

from pyspark.sql import functions as F

from roadlens.llm import fingerprints as fp
from roadlens.llm.queries import op4


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, following):
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def test_query_against_brute_force(spark, texts):
    rows = {r.doc_id: r for r in op4(spark, "/root/testdata/sf0.001").collect()}
    order = sorted(texts, reverse=True)
    errors = []
    for i, d in enumerate(order):
        following = texts[order[(i + 1) % len(order)]]
        new = edited(texts[d], following)
        r = rows[d]
        assert r.n_chars == len(texts[d])
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        errors.append(r.near_edited - likeness(shingles(texts[d]), shingles(new)))
        assert abs(r.near_next - likeness(shingles(texts[d]), shingles(following))) < 0.2
        if len(shingles(texts[d])) < fp.K and len(shingles(new)) < fp.K:
            assert abs(errors[-1]) < 1e-9 or len(shingles(texts[d]) | shingles(new)) > fp.K
    assert statistics.pstdev(errors) < 0.06
    assert len(rows) == len(texts)


def test_next_row_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_BUCKET", 3)
    ids = [i * i * 7919 % 100_003 for i in range(200)]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "none")], "k long, text string")
    found = {r.k: r.nxt for r in fp.with_next(df, "k", {"text": "nxt"}).collect()}
    order = [*sorted(set(ids), reverse=True), None]
    for a, b in zip(order, order[1:] + order[:1]):
        assert found[a] == ("none" if b is None else f"t{b}")


def test_merge_counts_and_containment(spark, docs):
    sketches = fp.with_sketch(docs, "text", "s")
    merged = fp.merge_groups(sketches, "lang", "s").select(
        "lang", fp.distinct_count(F.col("s")).alias("n"), F.size("s").alias("size"))
    truth: dict = {}
    for r in docs.collect():
        truth.setdefault(r.lang, set()).update(shingles(r.text))
    for r in merged.collect():
        assert r.size <= fp.K
        assert abs(r.n - len(truth[r.lang])) < 0.4 * len(truth[r.lang])
    pair = spark.createDataFrame([("a b c d e f g h i j", "a b c d e f g")], "x string, y string")
    pair = fp.with_sketch(fp.with_sketch(pair, "x", "p"), "y", "q")
    r = pair.select(fp.containment("q", "p").alias("in"), fp.containment("p", "q").alias("out")).head()
    assert r["in"] == 1.0 and abs(r["out"] - 0.5) < 1e-9


def test_odd_rows(spark, odd, empty, clashing):
    rows = fp.with_sketch(odd, "text", "s").collect()
    by = {}
    for r in rows:
        by.setdefault(r.text, set()).add(tuple(r.s))
    assert all(len(v) == 1 for v in by.values())
    assert by[None] == by[""] == {()}
    assert fp.with_sketch(empty, "text", "s").count() == 0
    assert fp.with_next(empty, "doc_id", {"text": "t"}).count() == 0
    assert fp.with_sketch(clashing, "text", "s").count() == len(rows)
    assert fp.with_next(clashing.drop("_bucket", "_next"), "doc_id", {"text": "t"}).count() == len(rows)
