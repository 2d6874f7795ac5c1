"""Byte-level BPE by a rank file: encoding and decoding whole texts.

A text is split by the vocabulary's pattern; each match (pre-token) starts as its bytes, and
the neighbours whose joined bytes have the lowest rank merge first, the leftmost of equals.
The work of all pre-tokens that a group of texts brings is one queue: a bucket per rank holds
places of a linked list, a bitmap of bitmaps tells the lowest rank with a bucket (find first
set), and entries that a merge has made stale are skipped when they are taken. All places of a
bucket merge at once; where a merge makes a pair of a lower rank, the rest of its pre-token
goes back to the bucket. A very long pre-token is no special case: its places are entries
like others, so time grows with its length and not with the square.

A pre-token that is itself in the vocabulary is one id. The ids of pre-tokens seen before are
kept per worker (``CACHED`` of them at least until the next group of texts). A null or empty text has no
ids and decodes to no bytes; null ids decode to null. Rows are independent, so repeated rows
give repeated results and an empty table an empty one."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from roadlens.llm import textscan as ts
from roadlens.llm.storage import let_workers_import

CACHED = 300_000
GROUP_BYTES = 1 << 24  # texts whose new pre-tokens share one queue
_CHUNK = 1 << 18  # pre-tokens of a long text that are held as strings at once
_LATIN_END = 0x250


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of lines ``base64 rank``."""
    import base64

    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class RankQueue:
    """Buckets of places by rank, the lowest rank first.

    A bit of the lowest level tells whether a rank has a bucket, a bit of the next level
    whether any of 64 ranks has, and so on to a single word."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.levels: list[list[int]] = []
        size = max(1, ranks)
        while not self.levels or size > 1:
            size = -(-size // 64)
            self.levels.append([0] * size)

    def push(self, rank: int, places: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(places)
            return
        self.buckets[rank] = [places]
        for level in self.levels:
            rank, bit = rank >> 6, rank & 63
            had, level[rank] = level[rank], level[rank] | 1 << bit
            if had:
                return

    def push_all(self, ranks: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        begins = [0, *cuts.tolist(), len(ranks)]
        for rank, lo, hi in zip(ranks[begins[:-1]].tolist(), begins[:-1], begins[1:], strict=True):
            self.push(rank, places[lo:hi])

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank and its places in order, without repeats."""
        word = self.levels[-1][0]
        if not word:
            return None
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank << 6 | ((word & -word).bit_length() - 1)
        at = rank
        for level in self.levels:
            at, bit = at >> 6, at & 63
            level[at] &= ~(1 << bit)
            if level[at]:
                break
        bucket = self.buckets.pop(rank)
        return rank, bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))


class Merger:
    """Merges many pre-tokens by the ranks of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.keys = np.array([*sorted(pairs), 1 << 62], np.int64)
        self.ranks = np.array([*(pairs[k] for k in self.keys[:-1].tolist()), self.size], np.int64)
        both = self.of_byte[:, None] * self.size + self.of_byte[None]
        self.of_bytes = self._ranks(both.ravel()).reshape(256, 256)

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], self.size)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of joined neighbours; ``size`` where there is no such token or no neighbour (-1)."""
        return np.where((left < 0) | (right < 0), self.size, self._ranks(left * self.size + right))

    def merge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens one after another, and where each one's ids begin (one more at the end)."""
        n, none = len(data), self.size
        ids = np.append(self.of_byte[data], -1)  # place n stands for no neighbour
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        borders = np.unique(offsets[:-1][np.diff(offsets) > 0])
        after[borders[1:] - 1] = n
        before[borders] = n
        rank = np.full(n + 1, none, np.int64)
        if n > 1:
            rank[: n - 1] = self.of_bytes[data[:-1], data[1:]]
            rank[borders[1:] - 1] = none
        queue = RankQueue(none)
        places = np.flatnonzero(rank < none)
        if len(places):
            queue.push_all(rank[places], places)
        while (taken := queue.pop()) is not None:
            new, places = taken
            places = places[rank[places] == new]  # the others are stale
            if not len(places):
                continue
            left = self._apart(places, after)
            right = after[left]
            beyond = after[right]
            joined = np.zeros(len(left), bool)  # the place before has just been merged as well
            joined[1:] = beyond[:-1] == left[1:]
            was = np.where(joined, new, ids[before[left]])
            self_id = np.full(len(left), new)
            to_left, to_right = self.pair_ranks(was, self_id), self.pair_ranks(self_id, ids[beyond])
            lower = (to_left < new) | (to_right < new)
            if lower.any():
                owner = np.searchsorted(borders, left, "right")
                stop = np.full(len(borders) + 1, n)
                np.minimum.at(stop, owner[lower], left[lower])
                now = left <= stop[owner]
                rest = places[places > stop[np.searchsorted(borders, places, "right")]]
                if len(rest):
                    queue.push(new, rest)
                left, right, beyond = left[now], right[now], beyond[now]
            ids[left] = new
            after[left] = beyond
            before[beyond] = left
            ids[right] = -1
            rank[right] = none
            begin = before[left]
            end_ids = ids[beyond]
            self_id = self_id[: len(left)]
            to_right = self.pair_ranks(self_id, end_ids)
            to_left = self.pair_ranks(ids[begin], self_id)
            rank[left] = to_right
            rank[begin] = to_left
            rank[n] = none
            at, ranks = np.concatenate([left, begin]), np.concatenate([to_right, to_left])
            live = ranks < none
            if live.any():
                queue.push_all(ranks[live], at[live])
        kept = ids[:n] >= 0
        starts = np.zeros(n + 1, np.int64)
        np.cumsum(kept, out=starts[1:])
        return ids[:n][kept], starts[offsets]

    @staticmethod
    def _apart(places: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of places whose pairs overlap the first, third and so on; all others."""
        chained = after[places[:-1]] == places[1:]
        if not chained.any():
            return places
        index = np.arange(len(places))
        begins = np.ones(len(places), bool)
        begins[1:] = ~chained
        first = np.maximum.accumulate(np.where(begins, index, 0))
        return places[(index - first) % 2 == 0]


class Splitter:
    """Matches of a vocabulary's pattern, letters and numbers as the tiktoken library knows them."""

    def __init__(self, pattern: str):
        import regex

        self.pattern = pattern
        self.whole = regex.compile(pattern)
        self.letters = regex.compile(r"[\p{L}\p{N}]")
        self.plain = re.compile(self._latin(pattern))
        self.stand_ins: dict[int, str] = {}
        self.known: set[str] = set()

    @staticmethod
    def _latin(pattern: str) -> str:
        """The pattern for texts below ``_LATIN_END``, with its classes spelled out."""
        chars = [chr(c) for c in range(_LATIN_END)]
        kinds = {r"\p{L}": [c for c in chars if unicodedata.category(c)[0] == "L"],
                 r"\p{N}": [c for c in chars if unicodedata.category(c)[0] == "N"],
                 r"\s": [c for c in "\t\n\x0b\f\r \x85\xa0"]}
        negated = {r"\S": kinds[r"\s"]}
        out, inside, at = "", False, 0
        while at < len(pattern):
            name = next((k for k in (*kinds, *negated) if pattern.startswith(k, at)), None)
            if name in negated:
                out += "[^" + "".join(map(re.escape, negated[name])) + "]"
            elif name:
                spelled = "".join(map(re.escape, kinds[name]))
                out += spelled if inside else f"[{spelled}]"
            elif pattern[at] == "\\":
                name = pattern[at:at + 2]
                out += name
            else:
                name = pattern[at]
                inside = name == "[" or inside and name != "]"
                out += name
            at += len(name)
        return out

    def _same_class(self, char: str) -> bool:
        """Whether the tiktoken library, too, takes the character for a letter or number."""
        import tiktoken

        tokens = {bytes([b]): b for b in range(256)}
        for pair in (char + "a", char + "1"):
            raw = pair.encode()
            for k in range(2, len(raw) + 1):
                tokens.setdefault(raw[:k], len(tokens))
        own = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=tokens, special_tokens={})
        return any(len(own.encode_ordinary(pair)) == 1 for pair in (char + "a", char + "1"))

    def _newer(self, text: str) -> bool:
        """Whether the text has characters that the two libraries see differently."""
        chars = set(text)
        for char in chars.difference(self.known):
            if ord(char) in self.stand_ins:
                continue
            # the libraries follow different versions of Unicode: only young characters can differ
            if unicodedata.category(char) == "Cn" and self.letters.match(char) and not self._same_class(char):
                self.stand_ins[ord(char)] = "͸"  # no letter in any version
            elif len(self.known) < 1 << 20:
                self.known.add(char)
        return not self.stand_ins.keys().isdisjoint(map(ord, chars))

    def chunks(self, text: str) -> Iterator[list[str]]:
        """The matches in order, some at a time."""
        finder, searched = self.plain, text
        if not text.isascii() and max(text) >= chr(_LATIN_END):
            finder = self.whole
            if self._newer(text):
                searched = text.translate(self.stand_ins)
        if len(text) < _CHUNK and searched is text:
            yield finder.findall(text)
            return
        found = finder.finditer(searched)
        while chunk := [text[m.start():m.end()] for m in islice(found, _CHUNK)]:
            yield chunk


class _Numbers(dict):
    """Pre-tokens and their numbers, given as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Codec:
    """Encoder and decoder of one vocabulary in one worker."""

    def __init__(self, path: str, pattern: str, cached: int = CACHED):
        ranks = read_ranks(path)
        self.merger, self.splitter, self.cached = Merger(ranks), Splitter(pattern), cached
        self.whole = ranks
        by_rank = [b""] * self.merger.size
        for token, rank in ranks.items():
            by_rank[rank] = token
        self.bytes_of = pa.array(by_rank, pa.large_binary())
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self) -> None:
        """Ids of the pre-tokens numbered since the last time."""
        new = [w.encode() for w in islice(self.numbers, len(self.starts) - 1, None)]
        if not new:
            return
        offsets = np.zeros(len(new) + 1, np.int64)
        np.cumsum([len(w) for w in new], out=offsets[1:])
        ids, starts = self.merger.merge(np.frombuffer(b"".join(new), np.uint8), offsets)
        counts = np.diff(starts)
        whole = np.array([self.whole.get(w, -1) for w in new])
        direct = np.flatnonzero((whole >= 0) & (counts > 1))  # tokens that merges do not reach
        if len(direct):
            keep = np.ones(len(ids), bool)
            for at in direct.tolist():
                ids[starts[at]] = whole[at]
                keep[starts[at] + 1:starts[at + 1]] = False
            ids, counts[direct] = ids[keep], 1
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + counts.cumsum()])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin (one more at the end)."""
        if len(self.numbers) > self.cached:
            self._forget()
        of, parts, sizes = self.numbers.__getitem__, [], []
        for text in texts:
            size = 0
            for chunk in self.splitter.chunks(text) if text else ():
                parts.append(np.fromiter(map(of, chunk), np.int32, len(chunk)))
                size += len(chunk)
            sizes.append(size)
        self._learn()
        offsets = np.zeros(len(texts) + 1, np.int64)
        if not parts:
            return np.zeros(0, np.int32), offsets
        words = np.concatenate(parts)
        counts = (self.starts[1:] - self.starts[:-1]).astype(np.int32)[words]
        ends = np.zeros(len(words) + 1, np.int64)
        np.cumsum(counts, out=ends[1:])
        np.cumsum(sizes, out=offsets[1:])
        places = np.repeat(self.starts[words] - ends[:-1], counts) + np.arange(ends[-1])
        return self.ids[places], ends[offsets]

    def decode(self, ids: pa.Array) -> tuple[pa.Buffer | None, np.ndarray]:
        """Bytes of all ids one after another, and where each id's bytes begin (one more at the end)."""
        taken = pc.take(self.bytes_of, ids)
        return taken.buffers()[2], np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec of a rank file, whose place is the same on every executor."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encoded(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the ``ids`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            _, offsets = ts.flat(batch.column(1))
            for lo, hi in ts.pieces(offsets, GROUP_BYTES):
                ids, starts = own.encode(batch.column(1).slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo),
                     pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids))], ["_key", "ids"])

    let_workers_import(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return (df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
            .mapInArrow(run, f"_key {kind}, ids array<int>").withColumnRenamed("_key", key))


def decoded(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes ``out`` of the column ``ids`` added."""
    if out == ids:
        raise ValueError("the bytes need a column of their own")
    df = df.drop(out)
    schema = StructType([*df.schema.fields, StructField(out, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = []
            for row in range(len(column)):
                one = column.slice(row, 1)
                if one.null_count:
                    texts.append(None)
                    continue
                raw, _ = own.decode(one.flatten())
                texts.append(raw.to_pybytes() if raw is not None else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], schema.names)

    let_workers_import(df.sparkSession)
    return df.mapInArrow(run, schema)
