"""Suffix-array dedup of repeated passages across documents.

A byte goes if a string of ``span`` bytes that covers it also starts in a document with a
smaller id. Every string of ``span`` bytes has an anchor, the smallest hash among the
18-byte grams in it (the first of equals), and equal strings have equal anchors. Documents
are dealt into blocks; a first pass finds the anchors that several documents hold, a second
one sends the strings around those, packed, to their anchor's range. There the strings are
sorted as suffixes, previous and next smaller documents in suffix order give the longest
previous factor of every position, and the chain of earlier matches its earliest
document. A last pass applies the verdicts to every copy in the blocks.

A block sends equal surroundings once, whatever the number of documents that hold them, and
the strings of an anchor with very many surroundings are dealt singly by their own
content, so that no group grows with the most frequent passage.

A null text is empty. A null id is larger than any other, and rows of one id (repeated
rows) do not remove each other's bytes. An empty table gives an empty result. Long
texts are read in overlapping slices, so the working memory does not follow their length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm import textscan as ts
from roadlens.llm.storage import let_workers_import

SPAN = 50
GRAM = 18
BLOCK_BYTES = 8 << 20
SLICE = 1 << 16
CHUNK = 1 << 16
HOT = 4096
LAST = np.iinfo(np.int64).max
_POSITION = ts.U64((1 << 22) - 1)


@dataclass
class Runs:
    """Neighbouring strings with one anchor: strings start at ``first .. last - 1``."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    digest: np.ndarray  # of the bytes first .. last + span - 2
    text: np.ndarray


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, done = len(x) - width + 1, 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:size], x[rest:rest + size]) if rest else x[:size]


def _slices(offsets: np.ndarray, span: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Byte ranges to look at, with the borders of the texts in them; a long text gives
    ranges that overlap by ``span - 1`` bytes."""
    for lo, hi in ts.pieces(offsets, SLICE):
        begin, end = int(offsets[lo]), int(offsets[hi])
        if end - begin <= 2 * SLICE:
            yield begin, end, offsets[lo:hi + 1] - begin
            continue
        for text in range(lo, hi):
            a, b = int(offsets[text]), int(offsets[text + 1])
            for at in range(a, max(a + 1, b - span + 1), SLICE):
                stop = min(b, at + SLICE + span - 1)
                yield at, stop, np.array([0, stop - at])


def runs(data: np.ndarray, offsets: np.ndarray, span: int = SPAN) -> Runs:
    """Runs of all texts, with places in ``data``."""
    found = []
    width = span - GRAM + 1
    for begin, end, borders in _slices(offsets, span):
        part = data[begin:end]
        size = len(part) - span + 1
        if size <= 0:
            continue
        sums = ts.prefix_sums(part)
        _, down = ts.powers(len(part) + 1)
        grams = sums[GRAM:] - sums[:-GRAM]
        grams *= down[: len(grams)]
        keyed = grams & ~_POSITION  # the high bits of the sums are spread well enough to choose by
        keyed |= np.arange(len(grams), dtype=ts.U64)
        place = _sliding_min(keyed, width)[:size]  # place and hash: they change together
        valid = np.ones(size, bool)
        for k in borders[1:-1][borders[1:-1] < len(part)].tolist():
            valid[max(0, k - span + 1):k] = False
        changes = place[1:] != place[:-1]
        new = valid.copy()
        new[1:] &= changes | ~valid[:-1]
        stop = valid.copy()
        stop[:-1] &= changes | ~valid[1:]
        first, last = np.flatnonzero(new), np.flatnonzero(stop) + 1
        place = (place[first] & _POSITION).astype(np.int64)
        digest = ts.mix((sums[last + span - 1] - sums[first]) * down[first] + (last - first).astype(ts.U64))
        # the smallest hashes are small numbers: mixed again they spread over all ranges
        found.append((first + begin, last + begin, ts.mix(grams[place]), digest))
    if not found:
        empty = np.zeros(0, np.int64)
        return Runs(empty, empty, empty.astype(ts.U64), empty.astype(ts.U64), empty)
    first, last, anchor, digest = (np.concatenate(x) for x in zip(*found, strict=True))
    return Runs(first, last, anchor, digest, np.searchsorted(offsets, first, "right") - 1)


def single(data: np.ndarray, some: Runs, span: int = SPAN) -> Runs:
    """The strings of the runs, each a run of its own."""
    count = some.last - some.first
    first = np.repeat(some.first, count) + _steps(count)
    digest = np.zeros(len(first), ts.U64)
    for lo in range(0, len(first), 1 << 16):  # a hash of each string's bytes, whatever its place
        at = first[lo:lo + (1 << 16)]
        total = np.zeros(len(at), ts.U64)
        for k in range(span):
            total = total * ts.U64(0x9E3779B97F4A7C15) + data[at + k].astype(ts.U64) + ts.U64(1)
        digest[lo:lo + (1 << 16)] = ts.mix(total)
    return Runs(first, first + 1, digest, digest ^ ts.U64(0xA5A5A5A5A5A5A5A5), np.repeat(some.text, count))


def _steps(count: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n of ``count``, one after another."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count)


def suffix_order(data: np.ndarray, starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``span`` bytes, and the length of the
    common beginning of each with the one before it in that order."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,)).astype(ts.U64)

    def key(begin: np.ndarray, at: int) -> np.ndarray:
        """Eight bytes from ``at`` on as a number, those beyond ``span`` as zeros."""
        found = words[begin + at]
        return found >> ts.U64(8 * (at + 8 - span)) << ts.U64(8 * (at + 8 - span)) if at + 8 > span else found

    size = len(starts)
    value = key(starts, 0)
    order = np.argsort(value)
    equal, places, at = np.zeros(size, bool), np.arange(size), 8  # equal: to the one before
    value = value[order]
    while len(places):  # places are in groups that share ``at`` bytes
        new = np.append(True, value[1:] != value[:-1])
        like, begin = ~new, starts[order[places]]
        for k in range(at, span, 8):
            own = key(begin, k)
            like[1:] &= own[1:] == own[:-1]
        equal[places] = like
        unlike = np.logical_or.reduceat(~(like | new), first := np.flatnonzero(new))
        open_ = np.repeat(unlike, np.diff(np.append(first, len(new))))
        places, begin = places[open_], begin[open_]
        if not len(places):
            break
        group = (np.cumsum(new[open_]) - 1).astype(ts.U64)
        width = (64 - max(8, int(group[-1]).bit_length())) // 8
        value = (group << ts.U64(8 * width)) | (key(begin, at) >> ts.U64(64 - 8 * width))
        by = np.argsort(value)
        order[places], value, at = order[places][by], value[by], at + width
    common = np.where(equal, span, 0)
    open_, begin = np.flatnonzero(~equal)[1:], starts[order]
    for at in range(0, span, 8):
        differs = key(begin[open_], at) ^ key(begin[open_ - 1], at)
        same = differs == 0
        common[open_[same]] = min(at + 8, span)
        apart, differs = open_[~same], differs[~same]
        for k in range(1, 8):
            common[apart[differs < ts.U64(1 << (64 - 8 * k))]] = at + k
        open_ = open_[same]
    return order, common


def _smaller(value: np.ndarray, common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest earlier place with a smaller value and the common beginning with it; the
    search stops where less than ``least`` is common. Pointers jump over places that
    were already found not to be smaller."""
    to, length = np.arange(len(value)) - 1, common.copy()
    active = np.flatnonzero((to >= 0) & (length >= least))
    active = active[value[to[active]] >= value[active]]
    while len(active):
        via = to[active]
        shared, next_ = np.minimum(length[active], length[via]), to[via]
        length[active], to[active] = shared, next_
        active = active[(next_ >= 0) & (shared >= least)]
        active = active[value[to[active]] >= value[active]]
    found = (to >= 0) & (length >= least)
    found[found] = value[to[found]] < value[found]
    return np.where(found, to, -1), np.where(found, length, 0)


def longest_previous_factor(value: np.ndarray, common: np.ndarray, least: int):
    """In suffix order: for every place the longest beginning shared with a place of smaller
    value, and that place (-1: none of ``least``)."""
    back, back_length = _smaller(value, common, least)
    turned = np.concatenate([[0], common[1:][::-1]]) if len(common) else common
    ahead, ahead_length = _smaller(value[::-1], turned, least)
    ahead = np.where(ahead[::-1] >= 0, len(value) - 1 - ahead[::-1], -1)
    ahead_length = ahead_length[::-1]
    return np.maximum(back_length, ahead_length), np.where(back_length >= ahead_length, back, ahead)


def earliest(value: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Smallest value among the places that share ``least`` with each place, itself included."""
    near = np.append(common[1:] >= least, False)
    near[1:] |= near[:-1]
    at = np.flatnonzero(near)  # the others share it with none
    out, value = value.copy(), value[at]
    _, source = longest_previous_factor(value, common[at], least)
    source = np.where(source < 0, np.arange(len(value)), source)
    while True:
        onward = source[source]
        if (onward == source).all():
            out[at] = value[source]
            return out
        source = onward


def _ids(table: pa.Table) -> np.ndarray:
    return np.asarray(table.column("id").to_numpy(), np.int64)


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value per part of an array, given the end of each part."""
    offsets = (np.append(0, ends) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [
        None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _joined(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows, one after another, and their number in each row."""
    item, parts, sizes = np.dtype(kind).itemsize, [], []
    for chunk in table.column(name).cast(pa.binary()).chunks:
        if len(chunk):
            ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset:][: len(chunk) + 1]
            raw = chunk.buffers()[2]
            parts.append((np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8))[ends[0]:ends[-1]])
            sizes.append(np.diff(ends) // item)
    if not parts:
        return np.zeros(0, kind), np.zeros(0, np.int64)
    return np.concatenate(parts).view(kind), np.concatenate(sizes).astype(np.int64)


def _low(values: np.ndarray, bits: int) -> np.ndarray:
    return ((values >> ts.U64(32 - bits)) & ts.U64(0xFFFFFFFF)).astype(np.uint32)


def _parts(anchors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that sorted anchors are in, and where each ends."""
    part = (anchors >> ts.U64(64 - bits)).astype(np.int64)
    ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)) if len(part) else part
    return part[ends - 1], ends


def _begins(values: np.ndarray) -> np.ndarray:
    """Where the sorted values change."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def _anchors(bits: int, span: int):
    """Block -> its anchors by range, with the number of documents that hold each."""

    def run(table: pa.Table) -> pa.Table:
        data, offsets = ts.flat(table.column("text"))
        found = runs(data, offsets, span)
        order = np.argsort(found.anchor)
        anchor, owner = found.anchor[order], _ids(table)[found.text[order]]
        begin = _begins(anchor)
        size = np.diff(np.append(begin, len(anchor)))
        count = np.ones(len(begin), np.int64)
        many = np.flatnonzero(size > 1)  # of equal anchors the owners are counted once
        of = np.repeat(np.arange(len(many)), size[many])
        owner = owner[np.repeat(begin[many], size[many]) + _steps(size[many])]
        order = np.lexsort((owner, of))
        owner, of = owner[order], of[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (owner[1:] != owner[:-1])
        count[many] = np.bincount(of[new], minlength=len(many))
        part, ends = _parts(anchor[begin], bits)
        return pa.table({"part": part, "block": np.full(len(part), table.column("block")[0].as_py(), np.int64),
                         "hashes": _binary(_low(anchor[begin], bits), ends),
                         "counts": _binary(np.minimum(count, 65535).astype(np.uint16), ends)})

    return run


def _common(table: pa.Table) -> pa.Table:
    """Range of anchors -> per block the anchors that several documents hold, and the hot ones."""
    (hashes, sizes), (counts, _) = _joined(table, "hashes", np.uint32), _joined(table, "counts", np.uint16)
    order = np.argsort(hashes)
    begin = _begins(hashes[order])
    total = np.empty(len(hashes), np.int64)
    total[order] = np.repeat(np.add.reduceat(counts[order], begin, dtype=np.int64) if len(begin) else begin,
                             np.diff(np.append(begin, len(hashes))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    shared, hot = total > 1, total > HOT
    n_shared, n_hot = (np.bincount(row[x], minlength=len(sizes)) for x in (shared, hot))
    out = pa.table({"block": table.column("block").cast(pa.int64()), "part": table.column("part").cast(pa.int64()),
                    "shared": _binary(hashes[shared], np.cumsum(n_shared)),
                    "hot": _binary(hashes[hot], np.cumsum(n_hot))})
    return out.filter(pa.array(n_shared > 0))


def _listed(table: pa.Table, name: str, bits: int) -> np.ndarray:
    """All listed anchors, as range and hash together, in order."""
    low, sizes = _joined(table, name, np.uint32)
    part = np.repeat(np.asarray(table.column("part").to_numpy(), np.int64), sizes).astype(ts.U64)
    return np.sort((part << ts.U64(32)) | low.astype(ts.U64))


def _among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(values), bool)
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values


def _part_of(some: Runs, keep: np.ndarray) -> Runs:
    return Runs(some.first[keep], some.last[keep], some.anchor[keep], some.digest[keep], some.text[keep])


def _candidates(data, offsets, said: pa.Table, bits: int, span: int) -> Runs:
    """Runs with a shared anchor; those of hot anchors string by string."""
    found = runs(data, offsets, span)
    found = _part_of(found, np.argsort(found.anchor))  # in order they are looked up faster
    key = found.anchor >> ts.U64(32 - bits)
    shared, hot = _listed(said, "shared", bits), _listed(said, "hot", bits)
    is_hot = _among(key, hot)
    usual = _part_of(found, _among(key, shared) & ~is_hot)
    apart = single(data, _part_of(found, is_hot), span)
    return Runs(*(np.concatenate([getattr(usual, f), getattr(apart, f)])
                  for f in ("first", "last", "anchor", "digest", "text")))


def _surroundings(bits: int, span: int):
    """Block and its common anchors -> distinct runs by range, with their smallest and largest id."""

    def run(docs: pa.Table, said: pa.Table) -> pa.Table:
        data, offsets = ts.flat(docs.column("text"))
        some, ids = Runs(*(np.zeros(0, np.int64) for _ in range(5))), np.zeros(0, np.int64)
        if docs.num_rows and said.num_rows:
            some, ids = _candidates(data, offsets, said, bits, span), _ids(docs)
        order = np.argsort(some.digest)
        begin, owner = _begins(some.digest[order]), ids[some.text[order]]
        least, most = ((x.reduceat(owner, begin) if len(begin) else begin) for x in (np.minimum, np.maximum))
        own = _part_of(some, order[begin])
        order = np.argsort(own.anchor)
        own, least, most = _part_of(own, order), least[order], most[order]
        anchor = own.anchor.astype(ts.U64)
        part, ends = _parts(anchor, bits)
        count = own.last - own.first
        packed, begin = [], 0
        for last in _batches(ends, CHUNK // (2 * span)):
            lo, hi = int(ends[begin - 1]) if begin else 0, int(ends[last - 1])
            size = count[lo:hi] + span - 1
            raw = data[np.repeat(own.first[lo:hi], size) + _steps(size)]
            to = np.append(0, np.cumsum(size))[ends[begin:last] - lo].tolist()
            packed += [zlib.compress(raw[a:b], 1) for a, b in zip([0, *to[:-1]], to, strict=True)]
            begin = last
        block = docs.column("block")[0].as_py() if docs.num_rows else 0
        return pa.table({"part": part, "block": np.full(len(part), block, np.int64),
                         "slices": _binary((anchor >> ts.U64(56 - bits)).astype(np.uint8), ends),
                         "counts": _binary(count.astype(np.uint16), ends), "bytes": pa.array(packed, pa.binary()),
                         "least": _binary(least, ends), "most": _binary(most, ends),
                         "digests": _binary(own.digest, ends)})

    return run


def _batches(ends: np.ndarray, limit: int) -> Iterator[int]:
    """Ends of batches of neighbouring parts, of about ``limit`` values or one part each."""
    begin = 0
    while begin < len(ends):
        done = int(ends[begin - 1]) if begin else 0
        begin = max(begin + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield begin


def _verdicts(span: int):
    """Range of runs -> per block the earliest document of every string, as stretches of runs.
    The range is looked at in slices, which equal strings share."""

    def run(table: pa.Table) -> pa.Table:
        slices, sizes = _joined(table, "slices", np.uint8)
        count = _joined(table, "counts", np.uint16)[0].astype(np.int64)
        (least, _), (most, _) = _joined(table, "least", np.int64), _joined(table, "most", np.int64)
        digest = _joined(table, "digests", np.uint64)[0]
        raw, packed = _joined(table, "bytes", np.uint8)
        data = np.frombuffer(b"".join(zlib.decompress(raw[b - n:b]) for n, b in zip(
            packed.tolist(), np.cumsum(packed).tolist(), strict=True)), np.uint8)
        block = np.repeat(np.asarray(table.column("block").to_numpy(), np.int64), sizes)
        begin = np.cumsum(count + span - 1) - (count + span - 1)
        order, out = np.argsort(slices, kind="stable"), []
        ends = np.append(_begins(slices[order]), len(order))[1:]
        done, upto = 0, np.cumsum(count[order])
        for last in _batches(upto[ends - 1] if len(ends) else ends, CHUNK):
            own, done = order[done:int(ends[last - 1])], int(ends[last - 1])
            length = count[own] + span - 1
            part = data[np.repeat(begin[own], length) + _steps(length)]
            of, step, long, source = _stretches(part, count[own], least[own], most[own], span)
            out.append((block[own[of]], digest[own[of]], step, long, source))
        block, digest, step, long, source = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (
            np.zeros(0, np.int64) for _ in range(5))
        order = np.argsort(block, kind="stable")
        begin = _begins(block[order])
        ends = np.append(begin, len(block))[1:]
        return pa.table({"block": block[order[begin]], "part": np.zeros(len(begin), np.int64),
                         "hot": pa.array([b""] * len(begin), pa.binary()),
                         "digests": _binary(digest[order].astype(np.uint64), ends),
                         "steps": _binary(step[order].astype(np.uint32), ends),
                         "lengths": _binary(long[order].astype(np.uint32), ends),
                         "sources": _binary(source[order], ends)})

    return run


def _stretches(data, count, least, most, span: int):
    """Stretches of the runs that lie in a smaller document as well: run, first string, number of
    strings, and the smallest document."""
    length = count + span - 1
    owner, step = np.repeat(np.arange(len(count)), count), _steps(count)
    order, common = suffix_order(data, (np.cumsum(length) - length)[owner] + step, span)
    source = np.empty(len(owner), np.int64)
    source[order] = earliest(least[owner[order]], common, span)
    hit = source < most[owner]
    onward = hit[:-1] & hit[1:] & (owner[1:] == owner[:-1]) & (source[1:] == source[:-1])
    first = np.flatnonzero(hit & np.append(True, ~onward)[: len(hit)])
    last = np.flatnonzero(hit & np.append(~onward, True)[: len(hit)]) + 1
    return owner[first], step[first], last - first, source[first]


def _removed(bits: int, span: int, as_text: bool):
    """Block and verdicts -> its rows with the remaining bytes (or text) and counts."""

    def run(docs: pa.Table, said: pa.Table) -> pa.Table:
        data, offsets = ts.flat(docs.column("text"))
        ids, gone = _ids(docs), np.zeros(len(data), bool)
        if docs.num_rows and said.num_rows:
            found = runs(data, offsets, span)
            found = _part_of(found, np.argsort(found.digest))
            hot = _listed(said, "hot", bits)
            apart = single(data, _part_of(found, _among(found.anchor >> ts.U64(32 - bits), hot)), span)
            digest = _joined(said, "digests", np.uint64)[0]
            order = np.argsort(digest)
            digest = digest[order]
            step, length = (_joined(said, c, np.uint32)[0].astype(np.int64)[order] for c in ("steps", "lengths"))
            source = _joined(said, "sources", np.int64)[0][order]
            change = np.zeros(len(data) + 1, np.int32)
            for some in (found, apart):
                lo, hi = np.searchsorted(digest, some.digest, "left"), np.searchsorted(digest, some.digest, "right")
                at = np.repeat(np.arange(len(lo)), hi - lo)
                which = np.repeat(lo, hi - lo) + _steps(hi - lo)
                later = source[which] < ids[some.text[at]]
                at, which = at[later], which[later]
                begin = some.first[at] + step[which]
                np.add.at(change, begin, 1)
                np.add.at(change, begin + length[which] + span - 1, -1)
            gone = np.cumsum(change[:-1], dtype=np.int32) > 0
        first, _, text = ts.spans(gone, offsets)
        n = len(offsets) - 1
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[offsets[1:]] - total[offsets[:-1]]
        kept = data[~gone]
        ends = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)])
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(kept)])
        if as_text:  # a character that was cut in two goes
            pieces = pa.array([p.decode("utf-8", "ignore") for p in pieces.to_pylist()], pa.string())
        else:
            pieces = pieces.cast(pa.binary())
        rest = docs.drop_columns(["block", "id", "text"])
        return pa.table({**{c: rest.column(c) for c in rest.column_names},
                         "kept": pieces, "n_bytes": np.diff(offsets),
                         "n_removed": removed, "n_spans": np.bincount(text, minlength=n)})

    return run


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN,
                    as_text: bool = False) -> DataFrame:
    """``df`` without its text, with ``kept`` (the remaining bytes, or the text they make),
    ``n_bytes``, ``n_removed`` and ``n_spans`` (maximal removed runs). Needs ``span`` of 32
    bytes or more."""
    let_workers_import(df.sparkSession)
    size = df.agg(F.sum(F.octet_length(text))).head()[0] or 0
    n_blocks = max(4, int(size // BLOCK_BYTES) + 1)
    # ranges are as large as blocks, as each block sends to each range
    bits = max(4, (n_blocks - 1).bit_length())
    others = [F.col(c).alias(f"_{i}") for i, c in enumerate(df.columns) if c != text]
    names = [(f"_{i}", c) for i, c in enumerate(df.columns) if c != text]
    whole = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(*others, F.coalesce(F.col(key).cast("long"), F.lit(int(LAST))).alias("id"), whole.alias("text"))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)))
    docs = docs.repartition("block")
    blocks = docs.groupBy("block")

    sent = blocks.applyInArrow(  # the same exchange serves all three passes
        _anchors(bits, span), "part long, block long, hashes binary, counts binary")
    said = sent.groupBy("part").applyInArrow(_common, "block long, part long, shared binary, hot binary")
    around = blocks.cogroup(said.groupBy("block")).applyInArrow(
        _surroundings(bits, span),
        "part long, block long, slices binary, counts binary, bytes binary, least binary, most binary, "
        "digests binary")
    verdicts = around.groupBy("part").applyInArrow(
        _verdicts(span), "block long, part long, hot binary, digests binary, steps binary, "
                         "lengths binary, sources binary")
    hot = said.filter(F.length("hot") > 0).select("block", "part", "hot")
    told = verdicts.unionByName(hot, allowMissingColumns=True)
    none = F.lit("").cast("binary")
    told = told.select("block", "part", *[F.coalesce(c, none).alias(c) for c in
                                          ("hot", "digests", "steps", "lengths", "sources")])
    fields = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in names)
    done = blocks.cogroup(told.groupBy("block")).applyInArrow(
        _removed(bits, span, as_text), (fields + ", " if fields else "")
        + f"kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long")
    clash = {"kept", "n_bytes", "n_removed", "n_spans"}
    return done.select(*[F.col(n).alias(c) for n, c in names if c not in clash], *sorted(clash))
