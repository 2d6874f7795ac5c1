from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from roadlens.llm import periodic_runs as pr
from roadlens.llm import textscan as ts
from roadlens.llm.queries import op12, with_periods
from tests.conftest import rows
from tests.llm.conftest import FOLDER, ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t, least=2):
    """All maximal stretches of every period; the smallest period of each stretch."""
    best, n = {}, len(t)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if t[i] == t[i + q]:
                j = i
                while j + q < n and t[j] == t[j + q]:
                    j += 1
                if j - i >= q and j + q - i >= least:
                    best.setdefault((i, j + q), q)
                i = j
            i += 1
    return sorted((s, e, q) for (s, e), q in best.items())


def some(rng, kind):
    n, few = rng.randrange(1, 300), lambda k: [rng.randrange(2) for _ in range(rng.randrange(k))]
    root = [rng.randrange(2) for _ in range(rng.randrange(1, 6))]
    if kind == 0:
        return few(300)
    if kind == 1:  # one long period
        p = [rng.randrange(3) for _ in range(rng.randrange(1, 60))]
        return few(20) + (p * 300)[:n] + few(20)
    if kind == 2:  # Fibonacci word
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 3:  # Thue-Morse word
        t = [0]
        while len(t) < n:
            t += [1 - x for x in t]
        return t[:n]
    if kind == 4:  # squares of periodic blocks
        block = (root * 60)[rng.randrange(2):][:rng.randrange(5, 70)]
        return few(9) + block * rng.randrange(2, 6) + few(9)
    if kind == 5:  # copies of copies
        t = [rng.randrange(3)]
        while len(t) < n:
            size = rng.randrange(1, len(t) + 1)
            at = rng.randrange(len(t) - size + 1)
            t = t + t[at:at + size] * rng.randrange(1, 4)
        return t[:n]
    left, right = ((root * 80)[rng.randrange(len(root)):][:rng.randrange(20, 200)] for _ in range(2))
    return few(4) + left + few(3) + right  # two regions that may meet


def symbols(t):
    return ts.mix(np.array(t, np.uint64) + np.uint64(7))


@pytest.mark.parametrize("kind", range(7))
def test_all_runs_against_brute_force(kind):
    rng = random.Random(kind)
    for _ in range(150):
        t = some(rng, kind)
        assert sorted(map(tuple, pr.all_runs(symbols(t)).tolist())) == brute(t)


def test_meeting_regions_are_needed():
    """A square whose halves are highly periodic has no chosen place; the seam gives it."""
    u = [0, 1]
    t = (u * 40)[:75] + (u * 40)[:75]
    found = sorted(map(tuple, pr.all_runs(symbols(t)).tolist()))
    assert found == brute(t) and any(q > 30 for *_, q in found)
    spans, runs = pr.Spans(symbols(t)), np.array(brute(t))
    assert len(pr._seams(spans, runs)[0])


def test_choice_depends_on_context():
    rng = random.Random(9)
    block = [rng.randrange(3) for _ in range(100)]
    spans = pr.Spans(symbols([5, 6] + block + [7, 8, 9] + block))
    chosen = set(pr.synchronising(spans, 8, np.zeros((0, 3), np.int64)).tolist())
    inner = range(2, 2 + 100 - 16 + 1)
    assert {i for i in inner if i in chosen} == {i - 103 for i in chosen if i - 103 in inner}


def expected(text):
    words = WORD.findall(text or "")
    runs = [(s, e - s, q) for s, e, q in brute(words, pr.LEAST)]
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def digest(doc_id, text):
    runs, kept = expected(text)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join("%d,%d,%d\n" % r for r in runs), kept)]
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha)


def damaged(doc_id, text):
    words, code = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
    if doc_id is None or code % 10 or not words:
        return text
    n, g = len(words), code // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(words[i if i < a else a + (i - a) % p] for i in range(n))


def test_query(spark, texts):
    short = {k: t for k, t in texts.items() if len(t or "") < 9_000}
    got = {r.doc_id: tuple(r) for r in op12(spark, FOLDER).collect()}
    assert len(got) == len(texts)
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k in short) > 5
    for k, t in short.items():
        assert got[k] == digest(k, damaged(k, t))


def test_periods_are_planted(spark):
    made = [(k, " ".join(f"w{i}" for i in range(k % 50))) for k in range(300)] + [(7, None), (None, "a b")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(with_periods(df)) == sorted(((k, damaged(k, t) or "") for k, t in made), key=repr)


def test_odd_rows(spark, odd, clashing, empty):
    want = sorted(((r[0], *expected(r[1])) for r in ODD if len(r[1] or "") < 1000 or " " not in r[1]), key=repr)
    for frame in (odd, clashing):
        got = [(r[0], [tuple(x) for x in r[1]], r[2]) for r in rows(
            pr.with_runs(frame).filter("n_words < 1000"), "doc_id", "runs", "collapsed")]
        assert sorted(got, key=repr) == want
    assert pr.with_runs(empty).count() == 0
    long = "a b c " * 50_000 + "end"
    (row,) = pr.with_runs(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(0, 150_000, 3)] and row.collapsed == "a b c end"
