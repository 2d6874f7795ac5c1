"""SentencePiece models on the tokenizers library: encoding and decoding whole texts.

The model protobuf is read field by field; normaliser, metaspace marker, scores and byte
fallback are rebuilt as a ``tokenizers`` pipeline. Unigram models keep their piece scores;
in BPE models the scores order the merges. Where no piece crosses from a letter into the
marker, words are independent: bounded caches of two generations keep the ids of words seen, and the words
new to a batch are encoded together on several threads. Every word that enters the cache is
compared with the sentencepiece library (``parity``), and every text is decoded from its
ids (``round_trip``).

A null or empty text has no ids and decodes to the empty text. Rows are independent, so
repeated rows give repeated results and an empty table gives an empty one."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm import textscan as ts
from roadlens.llm.storage import let_workers_import

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNKNOWN_TEXT = " ⁇ "
THREADS = 2
_PART = "\ue000\ue001"  # parts words that are encoded together


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 2:
            size, at = _varint(raw, at)
            value, at = raw[at:at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = raw[at:at + size], at + size
        yield tag >> 3, value


@dataclass
class Model:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True

    @classmethod
    def parse(cls, raw: bytes) -> Model:
        model = cls()
        for number, value in _fields(raw):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                model.pieces.append((piece, score, kind))
            elif number == 2:
                spec = dict(_fields(value))
                model.kind, model.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                model.charsmap = spec.get(2, b"")
                model.dummy_prefix, model.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        return model

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @property
    def splits_words(self) -> bool:
        """No piece has the marker after another character, and the text is taken as it is."""
        crossing = any(MARK in p.lstrip(MARK) for p, _, k in self.pieces if k in (NORMAL, USER))
        return not crossing and not self.charsmap and not self.squeeze and self.dummy_prefix

    def merges(self) -> list[tuple[str, str]]:
        """Pairs that make a piece, by falling score of the piece they make."""
        known = {p: i for i, (p, _, k) in enumerate(self.pieces) if k in (NORMAL, USER)}
        found = []
        for piece, i in known.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in known and right in known:
                    found.append((-self.pieces[i][1], i, known[left], known[right], left, right))
        return [(left, right) for *_, left, right in sorted(found)]

    def tokenizer(self, normalize: bool = True):
        """The model as a ``tokenizers`` pipeline; without ``normalize`` it takes marked text."""
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        if self.kind == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        elif self.kind == BPE:
            core = models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self.merges(),
                              unk_token=self.pieces[self.unknown][0], fuse_unk=True,
                              byte_fallback=self.byte_fallback)
        else:
            raise ValueError("only unigram and BPE models are read")
        made = Tokenizer(core)
        if normalize:
            steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
            if self.squeeze:
                steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
            steps += [normalizers.Prepend(MARK)] if self.dummy_prefix else []
            made.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        if not any(MARK in p.lstrip(MARK) for p, _, k in self.pieces if k in (NORMAL, USER)):
            made.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
        strip = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []
        made.decoder = decoders.Sequence(
            [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
        user = [AddedToken(p, normalized=False) for p, _, k in self.pieces if k == USER]
        if user:
            made.add_tokens(user)
        return made


class Codec:
    """Encoder and decoder of one model in one worker. About twice ``limit`` words are kept between
    calls: those of the present generation and of the one before."""

    WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def __init__(self, raw: bytes, threads: int = THREADS, limit: int = 250_000):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = Model.parse(raw)
        self.own = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.words = self.model.splits_words
        self.whole = self.model.tokenizer()
        self.threads, self.limit = threads, limit
        self.ids: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.unlike: set[str] = set()
        if self.words:
            self.alone = self.model.tokenizer(normalize=False)
            self.joined = self.model.tokenizer(normalize=False)
            self.joined.add_special_tokens([_PART])
            self.part_id = self.joined.token_to_id(_PART)
        self.text_of = pa.array([self._bytes(p, k) for p, _, k in self.model.pieces], pa.large_binary())

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return (UNKNOWN_TEXT if kind == UNKNOWN else piece.replace(MARK, " ")).encode()

    def _learn(self, new: list[str]) -> None:
        plain = [w for w in new if _PART not in w]
        size = max(1, -(-len(plain) // (4 * self.threads)))
        groups = [plain[lo:lo + size] for lo in range(0, len(plain), size)]
        done = self.joined.encode_batch_fast([_PART.join(g) for g in groups], add_special_tokens=False)
        for group, found in zip(groups, done, strict=True):
            ids = np.array(found.ids, "<u4")
            cuts = np.flatnonzero(ids == self.part_id)
            raw = ids.tobytes()
            first, last = [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(raw)]
            self.ids.update(zip(group, (raw[a:b] for a, b in zip(first, last, strict=True)), strict=True))
        for word in set(new).difference(plain):
            self.ids[word] = np.array(self.alone.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        new = [w for w in new if w != MARK]  # a single marker is the empty text's prefix there
        theirs = self.own.encode([w[1:].replace(MARK, " ") for w in new], num_threads=self.threads)
        for word, ids in zip(new, theirs, strict=True):
            if self.ids[word] != np.array(ids, "<u4").tobytes():
                self.unlike.add(word)

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of each text as little-endian 32-bit integers, and whether sentencepiece agrees."""
        if not self.words:
            ours = [e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False)]
            theirs = self.own.encode(texts, num_threads=self.threads)
            return [np.array(i, "<u4").tobytes() for i in ours], [a == b for a, b in zip(ours, theirs, strict=True)]
        split = [self.WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        missing = set().union(*split).difference(self.ids)
        known = missing.intersection(self.before)
        self.ids.update(zip(known, map(self.before.__getitem__, known), strict=True))
        new = missing.difference(known)
        if new:
            self._learn(sorted(new))
        of = self.ids.__getitem__
        same = [not self.unlike or self.unlike.isdisjoint(words) for words in split]
        out = [b"".join(map(of, words)) for words in split]
        if len(self.ids) > self.limit:  # only now, as these texts need all of their words
            self.before, self.ids = self.ids, {}
            self.unlike.intersection_update(self.before)
        return out, same

    def decode(self, ids: list[bytes]) -> list[str]:
        taken = pc.take(self.text_of, pa.array(np.frombuffer(b"".join(ids), "<i4")))
        data = memoryview(taken.buffers()[2] or b"")
        starts = np.frombuffer(taken.buffers()[1], np.int64)
        cuts = starts[np.array([0, *(len(i) // 4 for i in ids)], np.int64).cumsum()].tolist()
        out = []
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if self.model.dummy_prefix and data[begin:min(begin + 1, end)] == b" ":
                begin += 1
            out.append(str(data[begin:end], "utf-8", "replace"))
        return out


_CODECS: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    if path not in _CODECS:
        with open(path, "rb") as file:
            _CODECS[path] = Codec(file.read())
    return _CODECS[path]


def encoded(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every text, their checksum, the decoded text's digest and the two checks.

    ``path`` is the model file's place on every executor."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            _, offsets = ts.flat(batch.column(1))
            for lo, hi in ts.pieces(offsets):
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                ids, same = codec.encode(texts)
                back = codec.decode(ids)
                sizes = np.array([0, *(len(i) // 4 for i in ids)], np.int64).cumsum()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(np.diff(sizes)),
                    pa.ListArray.from_arrays(pa.array(sizes, pa.int32()),
                                             pa.array(np.frombuffer(b"".join(ids), "<i4"))),
                    pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back]),
                    pa.array([a == b for a, b in zip(texts, back, strict=True)]),
                    pa.array(same),
                ], names=["_key", "n_tokens", "ids", "ids_crc32", "decoded_sha256", "round_trip", "parity"])

    let_workers_import(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return (df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
            .mapInArrow(run, f"_key {kind}, n_tokens long, ids array<int>, ids_crc32 long, "
                             "decoded_sha256 string, round_trip boolean, parity boolean")
            .withColumnRenamed("_key", key))


def decoded(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``df`` with the text of a column of ids; null ids give null."""
    schema = df.drop(out).withColumn(out, F.lit("").cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = codec.decode([np.array(r or [], "<u4").tobytes() for r in rows])
            texts = [None if r is None else t for r, t in zip(rows, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.fieldNames())

    let_workers_import(df.sparkSession)
    return df.drop(out).mapInArrow(run, schema)
