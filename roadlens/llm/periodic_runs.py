"""Periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period ``q`` and at least ``2 q`` words that no
neighbouring word extends. For a scale ``t`` (a power of two) the synchronising set holds the
places ``i`` where, of the windows of ``t`` words that begin in ``i .. i + t``, the one of the
smallest hash begins first or last; windows that lie in a run of period ``<= t / 3`` do not
count. Whether a place is in the set depends on its context, the ``2 t`` words from it, alone.

* A run of period ``3 t <= q < 6 t`` repeats a chosen place of its first period, with its
  context, ``q`` words later. So all pairs of equal context at such distances propose their
  distance as period. Equal contexts lie over ``t / 3`` apart, hence every place has at
  most 18 partners, however often a context occurs.
* A run none of whose places is chosen has a first and a second period that each lie in a run
  of one small period ``p <= t / 3``, and these two runs touch or overlap: its own period
  is one of an arithmetic progression of step ``p``, found where the phases of the two agree.
* Periods below ``3 * SMALLEST`` are found by comparing each word with the one ``q`` before.

Each proposal is extended both ways as far as words agree and kept if it has two periods;
of several periods of one stretch the smallest stays. Only words of 6-grams that occur more
than once in their text are looked at: every run of 12 words or more consists of such words.

Words are compared by 64-bit hashes, spans by two residues modulo primes, and every run that
is kept is compared word by word. Whole texts are used; a null or empty text has no words
and no runs. Rows are independent, so repeated rows give repeated results and an empty table
gives an empty one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm import textscan as ts
from roadlens.llm.storage import let_workers_import

LEAST = 12  # words of a run
SMALLEST = 4  # the first scale
_GRAM = 6  # at most half of LEAST
_PRIMES = ((2147483647, 1103515245), (2147483629, 1299709))  # modulus and base, both fixed
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _power_table(n: int, base: int, prime: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = pow(base, len(out), prime)
        out = np.concatenate([out, out * ts.U64(step) % ts.U64(prime)])
    return out[:n]


class Spans:
    """Hashes of spans of an array of symbols, and how far two places agree."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.symbols, self.n, self.tables = symbols, n, []
        for prime, base in _PRIMES:
            p = ts.U64(prime)
            up = _power_table(n + 1, base, prime)
            down = _power_table(n + 1, pow(base, -1, prime), prime)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(ts.mix(symbols) % p * up[:n] % p, out=sums[1:])
            self.tables.append((p, sums % p, down))

    def hashes(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for p, sums, down in self.tables:
            value = (sums[starts + lengths] + p - sums[starts]) * down[starts] % p
            out = out << ts.U64(31) | value
        return out

    def agree_after(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Words from ``left`` and from ``right`` (to its right) on that are equal."""
        return self._longest(self.n - right, lambda k, at: self.hashes(left[at], k) == self.hashes(right[at], k))

    def agree_before(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Words up to, without, ``left`` and ``right`` that are equal."""
        return self._longest(left, lambda k, at: self.hashes(left[at] - k, k) == self.hashes(right[at] - k, k))

    @staticmethod
    def _longest(most: np.ndarray, same) -> np.ndarray:
        """The largest length up to ``most`` that is the ``same``, found by doubling and halving."""
        low, step = np.zeros(len(most), np.int64), np.ones(len(most), np.int64)
        open_ = np.flatnonzero(most > 0)
        while len(open_):  # double while equal
            size = np.minimum(low[open_] + step[open_], most[open_])
            ok = same(size, open_)
            low[open_[ok]] = size[ok]
            step[open_] = np.where(ok, step[open_] * 2, step[open_])
            open_ = open_[ok & (size < most[open_])]
        step = np.minimum(step, most - low)
        while len(open_ := np.flatnonzero(step > 0)):
            half = (step[open_] + 1) // 2
            size = np.minimum(low[open_] + half, most[open_])
            ok = same(size, open_)
            low[open_[ok]] = size[ok]
            step[open_] = np.where(ok, step[open_] - half, half - 1)
        return low


def _kept_smallest(runs: np.ndarray) -> np.ndarray:
    """Distinct (start, end) with the smallest period of each; rows are start, end, period."""
    if not len(runs):
        return runs
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[new]


def _small(symbols: np.ndarray, period: int) -> np.ndarray:
    """Maximal stretches of one period with at least two periods of words."""
    if len(symbols) <= period:
        return np.zeros((0, 3), np.int64)
    same = symbols[period:] == symbols[:-period]
    starts, ends, _ = ts.spans(same, np.array([0, len(same)]))
    found = np.stack([starts, ends + period, np.full(len(starts), period)], 1)
    return found[found[:, 1] - found[:, 0] >= 2 * period]


def _extended(spans: Spans, at: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """The stretches in which ``at`` and ``at + period`` agree, if two periods long."""
    if not len(at):
        return np.zeros((0, 3), np.int64)
    right = at + periods
    ends = right + spans.agree_after(at, right)
    starts = at - spans.agree_before(at, right)
    found = np.stack([starts, ends, periods], 1)
    return np.unique(found[ends - starts >= 2 * periods], axis=0)


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in any of the stretches."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return change[:n].cumsum() > 0


def synchronising(spans: Spans, scale: int, runs: np.ndarray) -> np.ndarray:
    """The synchronising set of a scale. ``runs`` hold all of period ``<= scale / 3``."""
    size = spans.n - scale + 1  # windows
    if size <= scale:
        return np.zeros(0, np.int64)
    key = ts.mix(spans.hashes(np.arange(size), scale)) >> ts.U64(1)
    none = ts.U64((1 << 64) - 1)
    inner = runs[(3 * runs[:, 2] <= scale) & (runs[:, 1] - runs[:, 0] >= scale)]
    key[_covered(size, inner[:, 0], inner[:, 1] - scale + 1)] = none
    least, width = key, 1
    while width < scale:  # scales are powers of two
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:-1], least[1:])  # over scale + 1 windows
    n = len(least)
    return np.flatnonzero((least != none) & ((key[:n] == least) | (key[scale:scale + n] == least)))


def _pairs(spans: Spans, places: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Chosen places of equal context and their distances of ``3 .. 6`` scales."""
    context = spans.hashes(places, 2 * scale)
    order = np.lexsort((places, context))
    places, context = places[order], context[order]
    at, periods, reach = [], [], 1
    left = np.arange(len(places) - 1)
    while len(left):
        left = left[left + reach < len(places)]
        gap = places[left + reach] - places[left]
        near = (context[left + reach] == context[left]) & (gap < 6 * scale)
        left, gap = left[near], gap[near]
        far = gap >= 3 * scale
        at.append(places[left[far]])
        periods.append(gap[far])
        reach += 1
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(at), np.concatenate(periods)


def _seams(spans: Spans, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods where two highly periodic regions of one period meet in equal phase."""
    long = runs[runs[:, 1] - runs[:, 0] >= 9 * runs[:, 2]]
    long = long[np.lexsort((long[:, 0], long[:, 2]))]
    meet = np.flatnonzero((long[1:, 2] == long[:-1, 2]) & (long[1:, 0] <= long[:-1, 1])) if len(long) > 1 else []
    at, periods = [], []
    for k in meet:
        (start, end, p), (next_start, next_end, _) = long[k].tolist(), long[k + 1].tolist()
        tries = np.arange(end - 2 * p + 1, end - p + 1)
        equal = tries[spans.hashes(tries, p) == spans.hashes(np.array([next_start]), p)[0]]
        if not len(equal):
            continue
        shift = next_start - int(equal[0])
        most = min(end - start, next_end - next_start, (next_end - start) // 2)
        found = np.arange(shift + max(0, -(-(9 * p - shift) // p)) * p, most + 1, p)
        periods.append(found)
        at.append(np.maximum(start, next_start - found))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(at), np.concatenate(periods)


def all_runs(symbols: np.ndarray) -> np.ndarray:
    """All runs of an array of 64-bit symbols as rows of start, end and period."""
    n = len(symbols)
    runs = np.concatenate([_small(symbols, q) for q in range(1, min(3 * SMALLEST, n // 2 + 1))]
                          or [np.zeros((0, 3), np.int64)])
    runs = _kept_smallest(runs)
    scale = SMALLEST
    if n < 6 * scale:
        return runs
    spans = Spans(symbols)
    while 6 * scale <= n:
        found = _pairs(spans, synchronising(spans, scale, runs), scale)
        runs = _kept_smallest(np.concatenate([runs, _extended(spans, *found)]))
        scale *= 2
    return _kept_smallest(np.concatenate([runs, _extended(spans, *_seams(spans, runs))]))


def _repeated(hashes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Words in a 6-gram that its text has more than once."""
    n = len(hashes)
    inside = np.zeros(n, bool)
    places, grams = ts.grams(hashes, texts, _GRAM)
    if not len(places):
        return inside
    grams = ts.mix(grams + texts[places].astype(np.uint64) * ts.U64(0x9E3779B97F4A7C15))
    order = np.argsort(grams, kind="stable")
    equal = grams[order[1:]] == grams[order[:-1]]
    twice = np.zeros(len(grams), bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    starts = places[twice]
    return _covered(n, starts, starts + _GRAM)


def runs_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``LEAST`` words or more of many texts (rows: text, start, length, period, in
    order), and the begins, ends and texts of all words."""
    begins, ends, texts = ts.words(data, offsets)
    none = np.zeros((0, 4), np.int64)
    hashes = ts.span_hashes(data, begins, ends)
    seen = _repeated(hashes, texts)
    if not seen.any():
        return none, begins, ends, texts
    borders = np.searchsorted(texts, np.arange(len(offsets)))
    lo, hi, _ = ts.spans(seen, borders)
    wide = hi - lo >= LEAST
    lo, hi = lo[wide], hi[wide]
    if not len(lo):
        return none, begins, ends, texts
    # the stretches one after another, a symbol of its own behind each
    sizes = hi - lo + 1
    first = np.concatenate([[0], sizes.cumsum()])
    place = np.arange(first[-1]) - np.repeat(first[:-1] - lo, sizes)
    last = first[1:] - 1
    symbols = hashes[np.minimum(place, len(hashes) - 1)]
    fresh = np.setdiff1d(np.arange(1, 2 * len(last) + 1, dtype=np.uint64) * ts.U64(0xD1B54A32D192ED03), symbols)
    while len(fresh) < len(last):  # only if words' hashes take them
        fresh = np.setdiff1d(np.arange(1, 8 * len(last) + 1, dtype=np.uint64) * ts.U64(0x8CB92BA72F3D8DD7), symbols)
    symbols[last] = fresh[: len(last)]
    found = all_runs(symbols)
    found = found[found[:, 1] - found[:, 0] >= LEAST]
    for start, end, period in found.tolist():  # exact, word by word
        if not np.array_equal(symbols[start:end - period], symbols[start + period:end]):
            raise ArithmeticError("two different spans have equal hashes")
    starts = place[found[:, 0]]
    out = np.stack([texts[starts], starts - borders[texts[starts]], found[:, 1] - found[:, 0], found[:, 2]], 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))], begins, ends, texts


def _collapsed(data, offsets, runs, begins, ends, texts) -> list[str]:
    """Each text's words without those that a run repeats, joined by one space."""
    first = np.searchsorted(texts, np.arange(len(offsets)))
    starts = first[runs[:, 0]] + runs[:, 1]
    gone = _covered(len(begins), starts + runs[:, 3], starts + runs[:, 2])
    begins, ends, texts = begins[~gone], ends[~gone], texts[~gone]
    # a word and the space behind it; the last of a text has none
    sizes = ends - begins + 1
    to = np.concatenate([[0], sizes.cumsum()])
    place = np.arange(to[-1]) - np.repeat(to[:-1] - begins, sizes)
    made = data[np.minimum(place, len(data) - 1)] if len(data) else data
    made[to[1:] - 1] = 32
    cuts = to[np.searchsorted(texts, np.arange(len(offsets)))]
    raw = made.tobytes()
    return [raw[a:max(a, b - 1)].decode("utf-8", "replace") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def with_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words``, ``runs`` (in order of start and period; word numbers from 0) and the
    ``collapsed`` text, which leaves out the words that a run has after its first period."""
    kind = df.schema[key].dataType.simpleString()
    struct = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ts.flat(batch.column(1))
            for lo, hi in ts.pieces(offsets):
                own, borders = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
                runs, begins, ends, texts = runs_of(own, borders)
                cuts = np.searchsorted(runs[:, 0], np.arange(hi - lo + 1))
                rows = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in (1, 2, 3)], fields=list(struct))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(np.bincount(texts, minlength=hi - lo)),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rows),
                    pa.array(_collapsed(own, borders, runs, begins, ends, texts), pa.string()),
                ], ["_key", "n_words", "runs", "collapsed"])

    let_workers_import(df.sparkSession)
    return (df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
            .mapInArrow(run, f"_key {kind}, n_words bigint, runs {RUN}, collapsed string")
            .withColumnRenamed("_key", key))
