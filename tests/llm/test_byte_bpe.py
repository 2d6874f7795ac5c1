from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from roadlens.llm import byte_bpe as bb
from roadlens.llm.queries import op13
from tests.conftest import rows
from tests.llm.conftest import FOLDER

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bb.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bb.Codec(PATH, PATTERN)


def ids_of(codec, texts):
    ids, starts = codec.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])]


def test_queue_gives_the_lowest_rank():
    rng, queue, held = random.Random(3), bb.RankQueue(70_000), set()
    import numpy as np
    for step in range(4000):
        if rng.random() < 0.6:
            rank = rng.choice([rng.randrange(70_000), rng.randrange(130)])
            queue.push(rank, np.array([step]))
            held.add(rank)
        elif held:
            assert queue.pop()[0] == min(held)
            held.remove(min(held))
        else:
            assert queue.pop() is None


@pytest.mark.parametrize("seed", range(6))
def test_any_order_of_ranks(seed, tmp_path):
    """Random vocabularies, in which a merge may make a pair of a lower rank."""
    rng = random.Random(seed)
    letters = "abc"[: 2 + seed % 2]
    tokens = {"".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))).encode() for _ in range(60)}
    order = [bytes([b]) for b in range(256)] + sorted(tokens)
    tail = list(range(256, len(order)))
    rng.shuffle(tail)
    ranks = dict(zip(order, [*range(256), *tail]))
    file = tmp_path / "ranks"
    file.write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in ranks.items()))
    codec = bb.Codec(str(file), PATTERN)

    def plain(word):
        if word in ranks:
            return [ranks[word]]
        parts = [word[i:i + 1] for i in range(len(word))]
        while True:
            best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1)
                        if parts[i] + parts[i + 1] in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    assert ids_of(codec, texts) == [plain(t.encode()) for t in texts]


def test_like_tiktoken(codec, theirs, texts):
    rng = random.Random(5)
    made = ["".join(rng.choice(a) for _ in range(rng.randrange(1, 80)))
            for a in ("ab", "'sretm 1!", " \n\tx\x85\xa0\x1c", "éßaǅ٣ 漢😀", "՘׾a1 ") for _ in range(100)]
    made += ["", " ", "x" * 200_000, " " * 3000 + "x", "﻿​", "<|endoftext|>", *texts.values()]
    assert ids_of(codec, made) == [theirs.encode_ordinary(t or "") for t in made]
    codec.cached = 10  # forgets between groups only
    assert ids_of(codec, made) == ids_of(codec, made[::-1])[::-1]


def test_long_text_in_chunks(codec, theirs, monkeypatch):
    monkeypatch.setattr(bb, "_CHUNK", 50)
    text = "It is said  that, in '24, we're there.\n\n " * 40
    assert ids_of(codec, [text, None]) == [theirs.encode_ordinary(text), []]


def digests(ids, raw):
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()


def test_query(spark, texts, theirs):
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op13(spark, FOLDER).collect()}
    assert found == {k: digests(theirs.encode_ordinary(t or ""), (t or "").encode()) for k, t in texts.items()}


def test_odd_rows(odd, clashing, empty, theirs):
    from tests.llm.conftest import ODD
    for frame in (odd, clashing):
        got = bb.decoded(bb.encoded(frame, PATH, PATTERN), PATH, PATTERN)
        want = sorted(((r[0], theirs.encode_ordinary(r[1] or ""), bytearray((r[1] or "").encode())) for r in ODD), key=repr)
        assert rows(got, "doc_id", "ids", "decoded") == want
    assert bb.decoded(bb.encoded(empty, PATH, PATTERN), PATH, PATTERN).count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(1, [64, 65], "x"), (2, None, "y"), (3, [], None)], "k long, ids array<int>, decoded string")
    own = bb.Codec(PATH, PATTERN)
    raw = own.bytes_of[64].as_py() + own.bytes_of[65].as_py()
    assert rows(bb.decoded(df, PATH, PATTERN)) == [(1, [64, 65], bytearray(raw)), (2, None, None), (3, [], bytearray())]
