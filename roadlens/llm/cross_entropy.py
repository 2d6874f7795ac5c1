"""Documents scored by the difference of two language models' losses.

Two bigram models over words share one vocabulary, order and smoothing: the target model
counts the documents labelled good, the background model counts all documents, scaled to the
target's number of tokens, so that neither gains by its size alone. A document's score is
its mean loss per token under the target model minus that under the background model:
the lower, the more it is like the target.

The vocabulary takes every word seen twice (the rest are one unknown word), the models every
bigram seen twice; others back off to the word. Neither has a largest size. Words and bigrams
are counted over all documents; tasks send their counts packed by ranges of hashes. That
takes as many passes over the texts as there are ``SLICES`` of the hashes, so that on disk lies what
one of them sends; what a step has sent or written goes when no later step reads it. A loss
-log((c + K p(b)) / (h(a) + K)) is the sum of a part of b, one of a and, where the bigram is
kept, one of it. So the models are a table of terms by the hash of a word or bigram, and a
document's loss is the sum of the terms of what it holds. A word seen once has one place, so
its term holds all that this place adds. The terms of the ``VOCABULARY`` most frequent words and
of the ``BIGRAMS`` most frequent bigrams are broadcast (at most about 17 MB); all other words
and bigrams of the documents are dealt by ranges of hashes, meet the table of terms there,
and their sums go back to the documents. These two parameters say only where a term is
looked up, not what the models hold.

A null or empty text has no token, no loss (null) and no score. A document repeated in
``labels`` is good if some row says so and none calls it toxic. Without target documents both
models are alike up to smoothing. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm import textscan as ts
from roadlens.llm.storage import let_workers_import, written_alone
from roadlens.session import forget

VOCABULARY, BIGRAMS = 1 << 16, 1 << 19
PRIOR_BIGRAM, PRIOR_WORD = 40.0, 100.0
FLUSH = 2_000_000
SLICES = 2
RANGE_BYTES = 24 << 20
# stand for the hashes of a text's beginning and end and of the unknown word
BEGIN, END, UNKNOWN = 0x1F3D5B79, 0x2E4C6A88, 0x3D5B7997
WORD, PAIR, LONE = 0, 1, 2  # kinds of rows: known words, kept bigrams, words seen once
SIDES = ("background", "target")


def _tokens(column):
    """Word hashes and texts of the pieces of a batch, and how many texts a piece has."""
    data, offsets = ts.flat(column)
    for lo, hi in ts.pieces(offsets):
        part = ts.LOWER[data[offsets[lo]:offsets[hi]]]
        starts, ends, texts = ts.words(part, offsets[lo:hi + 1] - offsets[lo])
        yield lo, hi, ts.span_hashes(part, starts, ends), texts


def _around(hashes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes before and after every word in its text."""
    before, after = np.empty_like(hashes), np.empty_like(hashes)
    before[1:], after[:-1] = hashes[:-1], hashes[1:]
    cut = np.flatnonzero(texts[1:] != texts[:-1])
    before[:1], after[-1:] = BEGIN, END
    before[cut + 1], after[cut] = BEGIN, END
    return before, after


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ts.mix(a * ts.U64(0xA0761D6478BD642F) + ts.mix(b ^ ts.U64(0xE7037ED1A0B428DB)))


def _distinct(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a place of each, and the sums of their count columns."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    begin = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])[:len(keys)])
    return sorted_[begin], order[begin], np.add.reduceat(counts[:, order], begin, axis=1) if len(keys) else counts


def _ranges(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Ranges of sorted keys by their first bits."""
    part = (keys >> ts.U64(64 - bits)).astype(np.int64)
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        if hi > lo:
            yield int(part[lo]), slice(lo, hi)


def _counted(df: DataFrame, bits: int, which: int) -> DataFrame:
    """Known words, kept bigrams and words seen once with their neighbours, from all rows:
    those whose hash is in slice ``which``."""

    def mine(keys, *columns):
        of = np.flatnonzero(keys % ts.U64(slices) == which)
        return [c[of] for c in (keys, *columns)]

    def packed(*places) -> pa.RecordBatch:
        rows = []
        hashes, before, after, good = mine(*places)
        keys, at, counts = _distinct(hashes, np.stack([np.ones(len(good), np.uint32), good]))
        lone = counts[0] == 1
        for kind, of in ((WORD, ~lone), (LONE, lone)):
            k, c, b, a = keys[of], counts[:, of], before[at[of]], after[at[of]]
            for part, g in _ranges(k, bits):
                around = np.concatenate([b[g], a[g]]).tobytes() if kind == LONE else b""
                rows.append((2 * part, kind, ts.planes(k[g]), around, *map(ts.planes, c[:, g].astype(np.uint32))))
        hashes, before, _, good = places
        keys, before, hashes, good = mine(paired(before, hashes), before, hashes, good)
        keys, at, counts = _distinct(keys, np.stack([np.ones(len(good), np.uint32), good]))
        for part, g in _ranges(keys, bits):
            order = np.argsort(before[at[g]])
            a, b, c = before[at[g]][order], hashes[at[g]][order], counts[:, g][:, order]
            rows.append((2 * part + 1, PAIR, ts.planes(a), ts.planes(b), *map(ts.planes, c.astype(np.uint32))))
        return pa.RecordBatch.from_pylist([dict(zip(sent.names, r, strict=True)) for r in rows], schema=sent)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            wanted = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint32)
            for lo, hi, hashes, texts in _tokens(batch.column(0)):
                held.append((hashes, *_around(hashes, texts), wanted[lo:hi][texts]))
                waiting += len(hashes)
                if waiting > FLUSH:
                    yield packed(*map(np.concatenate, zip(*held, strict=True)))
                    held, waiting = [], 0
        if waiting:
            yield packed(*map(np.concatenate, zip(*held, strict=True)))

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        counts = np.stack([np.concatenate([ts.unplaned(r[n], np.uint32) for r in rows]) for n in SIDES]).astype(np.int64)
        left = np.concatenate([ts.unplaned(r["left"], np.uint64) for r in rows])
        if rows[0]["kind"] == PAIR:
            right = np.concatenate([ts.unplaned(r["right"], np.uint64) for r in rows])
            key, at, counts = _distinct(paired(left, right), counts)
            keep = counts[0] > 1
            key, at, counts = key[keep], at[keep], counts[:, keep]
            kind, a, b = np.full(len(key), PAIR, np.int32), left[at], right[at]
        else:
            none = np.zeros(0, np.uint64)
            around = [np.frombuffer(r["right"], np.uint64).reshape(2, -1) if r["kind"] == LONE
                      else np.broadcast_to(none.sum(), (2, len(r["left"]) // 8)) for r in rows]
            around = np.concatenate(around, axis=1)
            key, at, counts = _distinct(left, counts)
            lone = counts[0] == 1
            kind = np.where(lone, LONE, WORD).astype(np.int32)
            a = np.where(lone, around[0][at], key)
            b = np.where(lone, around[1][at], paired(key, np.full_like(key, END)))
        return pa.table({"kind": kind, "key": key.view(np.int64), "a": a.view(np.int64), "b": b.view(np.int64),
                         **dict(zip(SIDES, counts, strict=True))})

    slices = SLICES
    sent = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("left", pa.binary()), ("right", pa.binary()),
                      *((n, pa.binary()) for n in SIDES)])
    let_workers_import(df.sparkSession)
    return df.mapInArrow(
        send, "part long, kind int, left binary, right binary, background binary, target binary"
    ).groupBy("part").applyInArrow(meet, "kind int, key long, a long, b long, background long, target long")


def _most(rows: DataFrame, limit: int) -> DataFrame:
    """The rows with the highest counts: above the lowest count that leaves at most ``limit``."""
    bins = rows.groupBy(F.least("background", F.lit(100_000)).alias("c")).count().collect()
    left, least = 0, None
    for c, n in sorted(((r[0], r[1]) for r in bins), reverse=True):
        if left + n > limit:
            break
        left, least = left + n, c
    return rows.filter(F.col("background") >= (least if least is not None else 1 << 62))


@dataclass
class Models:
    """Both models as a table of ``terms`` by ranges of ``bits`` bits, and the most frequent of them."""

    terms: DataFrame  # kind, key, background, v0, v1
    bits: int
    begin: np.ndarray  # what the beginning of a text adds (background, target)
    vocabulary: np.ndarray  # hashes of the words and bigrams whose terms are broadcast
    pairs: np.ndarray
    keys: np.ndarray  # these and the ends behind these words, sorted, with their terms
    values: np.ndarray


def train(df: DataFrame, good: str, text: str = "text") -> Models:
    """Both models from all rows of ``df``; rows with ``good`` count for the target as well."""
    texts = written_alone(df.select(text, good), "texts", compression="zstd")
    size = texts.agg(F.sum(F.octet_length(text))).head()[0] or 0
    bits = max(3, int(size // RANGE_BYTES).bit_length()) + 1
    slices = [written_alone(_counted(texts, bits, i), "counts") for i in range(SLICES)]
    forget(texts)
    counted = reduce(DataFrame.unionByName, slices)
    words, pairs, lone = (counted.filter(F.col("kind") == k) for k in (WORD, PAIR, LONE))

    sums = {r.kind: r for r in counted.groupBy("kind").agg(
        F.count("*").alias("n"), *(F.sum(n).alias(n) for n in SIDES)).collect()}
    tokens, strange = ([sum(sums[k][n] for k in kinds if k in sums) for n in SIDES]
                       for kinds in ((WORD, LONE), (LONE,)))
    slots = (sums[WORD].n if WORD in sums else 0) + 2
    scale = [tokens[1] / tokens[0], 1.0] if tokens[1] else [1.0, 1.0]

    def chance(count, i: int):
        return (count * scale[i] + PRIOR_WORD / slots) / (tokens[i] * scale[i] + PRIOR_WORD)

    def gain(count, p, i: int):
        """What a kept bigram takes from the loss of its second word."""
        return F.log1p(F.coalesce(count, F.lit(0)) * F.lit(scale[i]) / (p * PRIOR_BIGRAM))

    def past(count, i: int):
        return F.log(F.coalesce(count, F.lit(0)) * F.lit(scale[i]) + F.lit(PRIOR_BIGRAM))

    # bigrams with the unknown word: neighbours that were seen once themselves are it as well
    once = lone.select(F.col("key").alias("a"), F.lit(True).alias("a_lone"))
    lone = lone.join(once, "a", "left").join(once.toDF("b", "b_lone"), "b", "left")
    lone = written_alone(lone.select("key", "b", "target", F.when(F.col("a_lone"), F.lit(UNKNOWN)).otherwise(
        F.col("a")).alias("a"), (F.col("b_lone").isNull() & (F.col("b") != END)).alias("b_known")), "lone")
    each = [F.count("*").alias("c0"), F.sum("target").alias("c1")]
    second = words.select(F.col("key").alias("b"), *(chance(F.col(n), i).alias(f"p{i}") for i, n in enumerate(SIDES)))
    # written, so that the joins below can split a frequent neighbour's rows
    to_unknown = written_alone(lone.groupBy("a").agg(*each).filter("c0 > 1"), "to_unknown")
    from_unknown = written_alone(
        lone.filter("b_known").groupBy("b").agg(*each).filter("c0 > 1").join(second, "b"), "from_unknown")
    kept = [F.col("background").alias("c0"), F.col("target").alias("c1")]
    # unknown to unknown is in the first only
    history = pairs.select("a", *kept).unionByName(to_unknown).unionByName(
        from_unknown.select(F.lit(UNKNOWN).cast("long").alias("a"), "c0", "c1")
    ).groupBy("a").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    history = written_alone(history, "history")
    special = {r.a: r for r in history.filter(F.col("a").isin(BEGIN, UNKNOWN)).collect()}
    base = {a: np.log([(special[a][f"c{i}"] if a in special else 0) * scale[i] + PRIOR_BIGRAM for i in (0, 1)])
            for a in (BEGIN, UNKNOWN)}

    def alone(p, i: int):
        return -F.log(p * PRIOR_BIGRAM)

    known = words.select("key", "b", "background", "target").join(
        history.withColumnRenamed("a", "key"), "key", "left")
    of_words = known.select(F.lit(WORD).alias("kind"), "key", "background", *(
        (alone(chance(F.col(n), i), i) + past(F.col(f"c{i}"), i)).alias(f"v{i}") for i, n in enumerate(SIDES)))
    of_ends = known.select(F.lit(LONE + 1).alias("kind"), F.col("b").alias("key"), "background", *(
        (-past(F.col(f"c{i}"), i)).alias(f"v{i}") for i in (0, 1)))
    of_pairs = pairs.join(second, "b").select(F.lit(PAIR).alias("kind"), "key", "background", *(
        (-gain(F.col(n), F.col(f"p{i}"), i)).alias(f"v{i}") for i, n in enumerate(SIDES)))
    unknown = [chance(strange[i], i) for i in (0, 1)]
    places = lone.join(to_unknown.toDF("a", "t0", "t1"), "a", "left").join(
        from_unknown.toDF("b", "f0", "f1", "p0", "p1"), "b", "left")
    of_lone = places.select(F.lit(LONE).alias("kind"), "key", F.lit(1).cast("long").alias("background"), *(
        (F.lit(float(base[UNKNOWN][i] - np.log(unknown[i] * PRIOR_BIGRAM)))
         - gain(F.col(f"t{i}"), F.lit(float(unknown[i])), i)
         - F.when(F.col("p0").isNotNull(), gain(F.col(f"f{i}"), F.col(f"p{i}"), i)).otherwise(F.lit(0.0))
         - F.when(F.col("b") == END, F.lit(float(base[UNKNOWN][i]))).otherwise(F.lit(0.0))).alias(f"v{i}")
        for i in (0, 1)))
    terms = written_alone(of_words.unionByName(of_ends).unionByName(of_pairs).unionByName(of_lone), "terms")
    for step in (*slices, lone, to_unknown, from_unknown, history):
        forget(step)

    names = ["key", "v0", "v1"]
    first = [_most(terms.filter(F.col("kind") == k), n).select(*names).toArrow()
             for k, n in ((WORD, VOCABULARY), (PAIR, BIGRAMS), (LONE + 1, VOCABULARY))]
    hashes = [t.column("key").to_numpy().astype(np.int64).view(np.uint64) for t in first]
    keys = np.concatenate(hashes)
    values = np.concatenate([np.stack([t.column(n).to_numpy() for n in names[1:]]) for t in first], axis=1)
    order = np.argsort(keys)
    return Models(terms, bits, base[BEGIN], hashes[0], hashes[1], keys[order], values[:, order].astype(float))


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are among the sorted keys, and where."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return hit, at[hit]


def _bins(keys: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """Where the sorted keys with the same first bits begin, and by how much to shift for those bits."""
    bits = len(keys).bit_length() + 1
    shift = ts.U64(64 - bits)
    sizes = np.bincount((keys >> shift).astype(np.int64), minlength=1 << bits)
    return np.append(0, np.cumsum(sizes)).astype(np.int32), shift


def _found_by_bins(keys: np.ndarray, bins: tuple, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_found``, for unsorted ``wanted``: a bin has one key or two, where a search would jump about all keys."""
    first, shift = bins
    part = (wanted >> shift).astype(np.int32)
    at, end = first[part], first[part + 1]
    hit = np.zeros(len(wanted), bool)
    open_ = np.flatnonzero(at < end)
    while len(open_):
        same = keys[at[open_]] == wanted[open_]
        hit[open_[same]] = True
        open_ = open_[~same]
        at[open_] += 1
        open_ = open_[at[open_] < end[open_]]
    return hit, at[hit]


def scored(df: DataFrame, models: Models, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, tokens, mean losses and their difference of every row."""
    spark, bits, begin = df.sparkSession, models.bits, models.begin
    shared = spark.sparkContext.broadcast((models.keys, models.values))

    def packed(flush: int, keys, rows, docs) -> pa.RecordBatch:
        table = pa.table({"_key": pa.chunked_array([d[0] for d in docs]),
                          "count": np.concatenate([d[1] for d in docs]),
                          "l0": np.concatenate([d[2][0] for d in docs]),
                          "l1": np.concatenate([d[2][1] for d in docs])})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        own = int(ts.mix(np.array([flush], np.uint64))[0] >> ts.U64(64 - bits))
        sent = [(own, flush, None, None, sink.getvalue().to_pybytes())]
        order = np.argsort(keys)
        keys, rows = keys[order], rows[order]
        sent += [(part, flush, ts.planes(keys[g]), ts.planes(rows[g]), None) for part, g in _ranges(keys, bits)]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*sent, strict=True), kinds, strict=True)],
            names=["part", "flush", "keys", "rows", "docs"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        near, values = shared.value
        bins = _bins(near)
        flush = TaskContext.get().partitionId() << 32
        held, docs, rows, waiting = [], [], 0, 0
        for batch in batches:
            for lo, hi, hashes, texts in _tokens(batch.column(1)):
                before, after = _around(hashes, texts)
                last = np.flatnonzero(after == END)
                keys = np.concatenate([hashes, paired(before, hashes), paired(hashes[last], after[last])])
                place = np.concatenate([texts, texts, texts[last]])
                count = np.bincount(texts, minlength=hi - lo)
                hit, at = _found_by_bins(near, bins, keys)
                loss = np.stack([np.bincount(place[hit], v[at], hi - lo) for v in values]).astype(float)
                loss += np.where(count > 0, begin[:, None], 0.0)
                held.append((keys[~hit], (place[~hit] + rows).astype(np.uint32)))
                docs.append((batch.column(0).slice(lo, hi - lo), count, loss))
                rows += hi - lo
                waiting += len(held[-1][0]) + hi - lo
                if waiting > FLUSH:
                    yield packed(flush, *map(np.concatenate, zip(*held, strict=True)), docs)
                    held, docs, rows, waiting, flush = [], [], 0, 0, flush + 1
        if docs:
            yield packed(flush, *map(np.concatenate, zip(*held, strict=True)), docs)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right.column("key").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(keys)
        keys = keys[order]
        values = [right.column(n).to_numpy()[order] for n in ("v0", "v1")]
        out = []
        for r in left.select(["flush", "keys", "rows", "docs"]).to_pylist():
            if r["docs"] is not None:
                out.append((r["flush"], None, None, r["docs"]))
                continue
            hit, at = _found(keys, ts.unplaned(r["keys"], np.uint64))
            rows, back = np.unique(ts.unplaned(r["rows"], np.uint32)[hit], return_inverse=True)
            if len(rows):
                sums = np.stack([np.bincount(back, weights=v[at]) for v in values])
                out.append((r["flush"], ts.planes(rows), sums.tobytes(), None))
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds[1:], strict=True)],
                                    names=["flush", "rows", "sums", "docs"])

    def finish(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        docs, = (pa.ipc.open_stream(r["docs"]).read_all() for r in rows if r["docs"] is not None)
        count = docs.column("count").to_numpy()
        loss = np.stack([docs.column(n).to_numpy() for n in ("l0", "l1")])
        for r in rows:
            if r["rows"] is not None:
                loss[:, ts.unplaned(r["rows"], np.uint32)] += np.frombuffer(r["sums"]).reshape(2, -1)
        none = count == 0
        mean = np.divide(loss, count, out=np.zeros_like(loss), where=~none)
        return pa.Table.from_arrays(
            [docs.column("_key"), pa.array(count), pa.array(mean[1], mask=none), pa.array(mean[0], mask=none),
             pa.array(mean[1] - mean[0], mask=none)],
            names=["_key", "n_tokens", "target_loss", "background_loss", "score"])

    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    let_workers_import(spark)
    kind = df.schema[key].dataType.simpleString()
    sent = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        send, "part long, flush long, keys binary, rows binary, docs binary")
    terms = models.terms.select(F.shiftrightunsigned("key", 64 - bits).alias("part"), "key", "v0", "v1")
    return sent.groupBy("part").cogroup(terms.groupBy("part")).applyInArrow(
        meet, "flush long, rows binary, sums binary, docs binary"
    ).groupBy("flush").applyInArrow(
        finish, f"_key {kind}, n_tokens long, target_loss double, background_loss double, score double"
    ).withColumnRenamed("_key", key)


def good_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``good``: labelled of high quality and not toxic."""
    good = labels.filter(F.col(key).isNotNull()).groupBy(key).agg(
        ((F.max("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).alias("good"))
    # the texts are dealt by id whatever the number of labels, so that plans of all sizes are alike
    return docs.drop("good").join(good.hint("merge"), key, "left").withColumn("good", F.coalesce("good", F.lit(False)))


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    narrow = docs.select(key, text)
    return scored(narrow, train(good_rows(narrow, labels, key), "good", text), key, text)
