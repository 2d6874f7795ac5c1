from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np

from roadlens.llm import cutting_stock as cs
from roadlens.llm.registry import tokenizer_path
from roadlens.llm.storage import written
from roadlens.llm.word_cache import WordEncoder

PATH = tokenizer_path("word_bpe_49k.json")


def check(placed, ids_of, length):
    """Pieces cover every document once and sequences without a gap; gives the padding."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in placed:
        docs[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
        own = ids_of[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(own[r.start:r.start + r.length].tobytes())
    assert set(docs) == set(ids_of)
    padding = 0
    for d, parts in docs.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
        assert at == len(ids_of[d])
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
        padding += length - at if at & (at - 1) else 0
    assert sorted(sequences) == list(range(len(sequences)))
    return padding


def direct(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    return {d: np.array(own.encode(t or "", add_special_tokens=False).ids + [cs.END_ID], "<u4") for d, t in texts.items()}


def test_documents(docs, texts):
    assert check(cs.pack(docs, PATH).collect(), direct(texts), cs.LENGTH) == 0


def test_sequences_are_the_ids(docs, texts):
    cut = written(cs.pieces(docs, PATH), "pieces")
    placed = written(cs.packed(cut), "placed")
    ids = direct(texts)
    whole = defaultdict(list)
    for r in placed.collect():
        whole[r.sequence_id].append((r.offset, ids[r.doc_id][r.start:r.start + r.length]))
    for r in cs.sequences(cut, placed).collect():
        expected = np.concatenate([i for _, i in sorted(whole[r.sequence_id], key=lambda x: x[0])])
        assert bytes(r.ids) == expected.tobytes() and r.n_ids == len(expected)


def test_word_cache_is_exact():
    odd = ["Don't  STOP\tit's\r\n", "a<|endoftext|>b <|startoftext|>", "É é Σς ﬁ 漢字😀 12a", "", "\x1c a\x85b c",
           "x" * 3000, "á ́"]
    for limit in (400_000, 4):
        encoder = WordEncoder(PATH, limit)
        for _ in range(2):
            for text, raw in zip(odd, encoder.encode(odd)):
                expected = encoder.tokenizer.encode(text, add_special_tokens=False).ids
                assert np.frombuffer(raw, "<u4").tolist() == expected


def test_patterns_meet_demand_near_the_bound():
    rng = np.random.default_rng(2)
    demand = rng.integers(0, 900, 60).astype(float)
    sizes = np.flatnonzero(demand) + 1
    demand = demand[demand > 0]
    rows, use = cs.patterns(sizes, demand, 64)
    assert (rows @ sizes <= 64).all()
    assert np.allclose(rows.T @ use, demand, atol=1e-4 * demand.max()) or (rows.T @ use >= demand - 1e-3).all()
    assert use.sum() <= 1.05 * (sizes @ demand) / 64 + 1 or sizes.max() > 32


def test_price_is_the_best_knapsack():
    rng = random.Random(1)
    for _ in range(30):
        sizes = np.array(sorted(rng.sample(range(1, 15), 4)))
        values = np.array([rng.random() for _ in sizes])
        best = max(float(values @ np.array([a, b, c, d]))
                   for a in range(21) for b in range(21) for c in range(21) for d in range(21)
                   if sizes @ np.array([a, b, c, d]) <= 20) if sizes[0] > 3 else None
        counts = cs.price(values, sizes, 20)
        assert sizes @ counts <= 20
        if best is not None:
            assert abs(values @ counts - best) < 1e-9


def test_odd_rows(odd, empty, clashing):
    rows = cs.pack(odd, PATH).collect()
    assert sum(r.length for r in rows) == sum(
        len(x) for x in direct({i: r.text for i, r in enumerate(odd.collect())}).values())
    assert cs.pack(empty, PATH).count() == 0
    assert cs.pack(clashing, PATH).count() == len(rows)
