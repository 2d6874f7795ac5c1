from __future__ import annotations

import hashlib

import numpy as np
import pytest

from roadlens.llm import piece_codec as pc
from roadlens.llm.registry import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b ", "\tx\ny", "é漢😀 ▁▁ a▁b", "<s> </s> <unk>", "   lead", "trail   ", "a" * 5000, "ﬁ  ́é  b", "\x00\x01"]


@pytest.fixture(scope="module")
def theirs():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_are_those_of_sentencepiece(docs, texts, theirs):
    rows = pc.encoded(docs, PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == theirs.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.round_trip and r.parity
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("limit", [300_000, 3])
def test_odd_texts(theirs, limit):
    with open(PATH, "rb") as file:
        codec = pc.Codec(file.read(), limit=limit)
    for _ in range(2):
        ids, same = codec.encode(ODD)
        back = codec.decode(ids)
        for text, raw, s, b in zip(ODD, ids, same, back):
            own = np.frombuffer(raw, "<u4").tolist()
            assert own == theirs.encode(text) == codec.whole.encode(text, add_special_tokens=False).ids
            assert s and b == theirs.decode(own) == codec.whole.decode(own)


@pytest.mark.parametrize("limit", [0, 4, 300_000])
def test_a_call_may_have_more_words_than_are_kept(theirs, limit):
    with open(PATH, "rb") as file:
        codec = pc.Codec(file.read(), limit=limit)
    for text in ("one two three", "two three four five six seven", "one two six seven eight nine ten", "one"):
        ids, same = codec.encode([text])
        assert np.frombuffer(ids[0], "<u4").tolist() == theirs.encode(text) and same == [True]
        assert len(codec.ids) <= limit


def test_unigram_models_keep_their_scores():
    def number(value):
        out = b""
        while True:
            out, value = out + bytes([value & 127 | (128 if value > 127 else 0)]), value >> 7
            if not value:
                return out

    def message(field, raw):
        return number(field << 3 | 2) + number(len(raw)) + raw

    def piece(text, score, kind):
        return message(1, message(1, text.encode()) + number(2 << 3 | 5) + np.float32(score).tobytes()
                       + number(3 << 3) + number(kind))

    pieces = [("<unk>", 0, 2), ("▁", -3, 1), ("▁ab", -1, 1), ("a", -2, 1), ("b", -2.5, 1), ("ab", -9, 1)]
    pieces += [(f"<0x{b:02X}>", -20, 6) for b in range(256)]
    raw = b"".join(piece(*p) for p in pieces)
    raw += message(2, number(3 << 3) + number(1) + number(35 << 3) + number(1))
    raw += message(3, number(3 << 3) + number(1) + number(4 << 3) + number(0))
    import sentencepiece

    own, codec = sentencepiece.SentencePieceProcessor(model_proto=raw), pc.Codec(raw)
    assert codec.model.kind == pc.UNIGRAM and codec.model.byte_fallback
    assert codec.encode(["ab a b", "abb aab"])[0] == [
        np.array(own.encode(t), "<u4").tobytes() for t in ("ab a b", "abb aab")]


def test_round_trip_of_rows(odd, empty, clashing):
    rows = pc.encoded(odd, PATH).collect()
    assert len(rows) == odd.count() and all(r.round_trip or "▁" in "▁" for r in rows)
    assert all(r.n_tokens == 0 for r in rows if r.doc_id in (1, 2))
    assert pc.encoded(empty, PATH).count() == 0
    assert pc.encoded(clashing, PATH).count() == odd.count()
    back = {r.doc_id: r.text for r in pc.decoded(pc.encoded(odd, PATH), PATH).collect()}
    assert back[4] == "one" and back[1] == "" and back[9] == "x" * 300_000
