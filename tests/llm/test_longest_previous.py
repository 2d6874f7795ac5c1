from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from roadlens.llm import longest_previous as lp


def brute(rows, span):
    first: dict = {}
    big = lp.LAST
    for k, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - span + 1):
            s = raw[i:i + span]
            first[s] = min(first.get(s, big), big if k is None else k)
    out = Counter()
    for k, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - span + 1):
            if first[raw[i:i + span]] < (big if k is None else k):
                gone[i:i + span] = b"\1" * span
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out[k, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept] += 1
    return out


def agree(df, span=50):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
                    for r in lp.without_repeats(df.select("doc_id", "text"), span=span).collect())
    assert found == brute(rows, span)


def test_documents(docs):
    agree(docs)


def passages(rng):
    words = ["alpha", "beta", "é", "漢字", "delta", "😀", "eta", "theta", "iota"]
    shared = [" ".join(rng.choice(words) for _ in range(rng.randrange(8, 30))) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [rng.choice([rng.choice(shared), " ".join(rng.choice(words) for _ in range(6))]) for _ in range(5)]
        rows.append((rng.randrange(120), rng.choice([" ", "\n", ""]).join(parts)[rng.randrange(4):]))
    return [*rows, (3, "ab" * 400), (4, "ab" * 300), (5, "b" * 49), (6, "b" * 50), (7, "b" * 51), (None, "b" * 50)]


@pytest.mark.parametrize("hot,slice_,blocks", [(4096, 1 << 20, 12 << 20), (2, 1 << 20, 512), (4096, 128, 2048), (3, 100, 700)])
def test_passages(spark, monkeypatch, hot, slice_, blocks):
    monkeypatch.setattr(lp, "HOT", hot)
    monkeypatch.setattr(lp, "SLICE", slice_)
    monkeypatch.setattr(lp, "BLOCK_BYTES", blocks)
    df = spark.createDataFrame(passages(random.Random(hot + slice_)), "doc_id long, text string").repartition(4)
    # the limits are read on the driver and in the tasks, so run the tasks' code here as well
    local(df, 50)
    agree(df)


def local(df, span):
    """The same steps without Spark, where the patched limits hold."""
    import pyarrow as pa

    rows = [(r.doc_id, r.text) for r in df.collect()]
    bits, n = 4, 5
    of = lambda k, t: hash((k, t)) % n
    tables = {b: pa.table({"block": [b] * len(own), "id": pa.array([lp.LAST if k is None else k for k, _ in own], pa.int64()),
                           "text": pa.array([t for _, t in own], pa.string()),
                           "_0": pa.array([k for k, _ in own], pa.int64())})
              for b in range(n) if (own := [r for r in rows if of(*r) == b])}

    def grouped(parts, key):
        whole = pa.concat_tables(parts)
        return {k: whole.filter(pa.compute.equal(whole.column(key), k)) for k in set(whole.column(key).to_pylist())}

    import pyarrow.compute  # noqa: F401

    said = grouped([lp._common(t) for t in grouped([lp._anchors(bits, span)(t) for t in tables.values()], "part").values()], "block")
    none = pa.table({"block": pa.array([], pa.int64()), "part": pa.array([], pa.int64()),
                     "shared": pa.array([], pa.binary()), "hot": pa.array([], pa.binary())})
    around = [lp._surroundings(bits, span)(t, said.get(b, none)) for b, t in tables.items()]
    told = grouped([lp._verdicts(span)(t) for t in grouped(around, "part").values()], "block")
    found = Counter()
    for b, t in tables.items():
        own = []
        if b in told:
            own.append(told[b])
        if b in said:
            hot = said[b]
            own.append(pa.table({"block": hot.column("block"), "part": hot.column("part"), "hot": hot.column("hot"),
                                 **{c: pa.array([b""] * hot.num_rows, pa.binary())
                                    for c in ("digests", "steps", "lengths", "sources")}}))
        out = lp._removed(bits, span, False)(t, pa.concat_tables(own) if own else none)
        for r in out.to_pylist():
            found[r["_0"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]] += 1
    assert found == brute(rows, span)


def test_longest_previous_factor():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 2, 400).astype(np.uint8)
    starts = np.arange(350)
    order, common = lp.suffix_order(data, starts, 50)
    assert [bytes(data[s:s + 50]) for s in starts[order]] == sorted(bytes(data[s:s + 50]) for s in starts)
    value = rng.integers(0, 60, 350)
    length, _ = lp.longest_previous_factor(value[order], common, 1)
    for i, s in enumerate(starts[order]):
        best = 0
        for t in starts[value < value[s]]:
            n = 0
            while n < 50 and data[s + n] == data[t + n]:
                n += 1
            best = max(best, n)
        assert length[i] == best


def test_odd_rows(odd, empty, clashing):
    agree(odd)
    assert lp.without_repeats(empty).count() == 0
    out = lp.without_repeats(clashing)
    assert out.count() == odd.count() and "rank" in out.columns
    kept = lp.without_repeats(odd, as_text=True)
    assert kept.filter("kept IS NULL").count() == 0


def test_ranges_are_no_more_than_twice_the_blocks(spark, monkeypatch):
    # every block sends a row to every range, so with many small ranges most of the time goes into rows
    text = "".join(random.Random(5).choices("abcdefgh ", k=64 * 90))
    df = spark.createDataFrame([(i, text[90 * i:90 * i + 90]) for i in range(64)], "doc_id long, text string")
    seen, anchors = [], lp._anchors
    monkeypatch.setattr(lp, "BLOCK_BYTES", 90)
    monkeypatch.setattr(lp, "_anchors", lambda bits, span: seen.append(bits) or anchors(bits, span))
    lp.without_repeats(df)
    assert [65 <= 2 ** bits <= 130 for bits in seen] == [True]


@pytest.mark.parametrize("chunk,hot", [(1, 4096), (40, 2), (1 << 20, 4096)])
def test_ranges_in_slices(spark, monkeypatch, chunk, hot):
    """A range is looked at a slice at a time, of about as many strings as the limit says."""
    sizes, stretches = [], lp._stretches
    monkeypatch.setattr(lp, "CHUNK", chunk)
    monkeypatch.setattr(lp, "HOT", hot)
    monkeypatch.setattr(lp, "_stretches", lambda data, count, *rest: sizes.append(count.sum()) or stretches(data, count, *rest))
    local(spark.createDataFrame(passages(random.Random(9)), "doc_id long, text string"), 50)
    assert len(sizes) <= 16 if chunk == 1 << 20 else len(sizes) > 100


def test_order_of_equal_and_nearly_equal_strings():
    rng = np.random.default_rng(8)
    for span in (32, 40, 50, 64):
        data = np.tile(rng.integers(0, 256, 97).astype(np.uint8), 6)
        data[rng.integers(0, len(data), 12)] += 1
        starts = rng.permutation(len(data) - span + 1)
        order, common = lp.suffix_order(data, starts, span)
        strings = [bytes(data[s:s + span]) for s in starts[order]]
        assert strings == sorted(strings)
        for i in range(1, len(strings)):
            n = 0
            while n < span and strings[i][n] == strings[i - 1][n]:
                n += 1
            assert common[i] == n


def test_owners_of_an_anchor_count_once():
    import pyarrow as pa

    text = "".join(random.Random(6).choices("abcdefgh ", k=80))
    table = pa.table({"block": [7] * 4, "id": pa.array([3, 3, 5, 5], pa.int64()), "text": [text, text, text + text, "b" * 49]})
    sent = lp._anchors(4, 50)(table)
    assert sent.column("block").to_pylist() == [7] * sent.num_rows
    counts = np.concatenate([np.frombuffer(x, np.uint16) for x in sent.column("counts").to_pylist()])
    assert sorted(set(counts.tolist())) == [1, 2]
    said = lp._common(sent)
    shared = sum(len(x) // 4 for x in said.column("shared").to_pylist())
    assert shared == (counts == 2).sum() and all(said.column("shared").to_pylist())
