"""Packing documents into sequences by cutting-stock column generation.

A document's ids (its tokens and one closing id) are cut into whole sequences and a rest.
The histogram of rests, in classes of ``STEP`` ids, is the demand of a cutting-stock
problem: a linear program over patterns of classes, whose columns a knapsack dynamic program
prices. Patterns, rounded down, take the documents of a class by rank. What the rounding
leaves over (documents beyond the patterns' places) is cut to fill the places that remain
in the patterns' sequences, and then whole sequences; the very last ids go into
sequences whose lengths are powers of two, so nothing is padded.

The linear program sees the histogram only, of bounded size; ranks, offsets and fillings
are distributed. A null or empty text is one closing id. Rows that repeat a ``doc_id`` are
packed each; rows with a null id too. An empty table gives no piece."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlens.llm import textscan as ts
from roadlens.llm.storage import let_workers_import, written
from roadlens.llm.word_cache import WordEncoder

LENGTH = 4096
STEP = 16
END_ID = 2
SALTS = 64

_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Every document's ids in pieces of ``length`` ids and a shorter rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        closing = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            _, offsets = ts.flat(batch.column(1))
            for lo, hi in ts.pieces(offsets):
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                owner, start, total, parts = [], [], [], []
                for i, raw in enumerate(encoder.encode(texts)):
                    raw += closing
                    for at in range(0, len(raw), 4 * length):
                        owner.append(i)
                        start.append(at // 4)
                        total.append(len(raw) // 4)
                        parts.append(raw[at:at + 4 * length])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo).take(pa.array(owner, pa.int32())).cast(pa.int64()),
                    pa.array(start, pa.int64()), pa.array([len(p) // 4 for p in parts], pa.int64()),
                    pa.array(total, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                    pa.array(parts, pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids"])

    let_workers_import(df.sparkSession)
    cut_up = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        cut, "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary")
    return cut_up.withColumn("piece", F.monotonically_increasing_id())


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack by dynamic programming: the counts of items with the largest value."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        fits = np.searchsorted(sizes, w, "right")
        best[w], choice[w] = best[w - 1], -1
        if fits:
            gain = values[:fits] + best[w - sizes[:fits]]
            i = int(gain.argmax())
            if gain[i] > best[w] + 1e-12:
                best[w], choice[w] = gain[i], i
    counts, w = np.zeros(len(sizes), np.int64), capacity
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            counts[choice[w]] += 1
            w -= int(sizes[choice[w]])
    return counts


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000):
    """Column generation: patterns (one per row) and how often the linear program uses each.

    The basis starts with one pattern per class; the dual prices of the classes make the
    knapsack whose solution enters, until none is worth more than a sequence."""
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1 / np.diag(basis))
    use = inverse @ demand
    for turn in range(rounds):
        duals = inverse.sum(0)
        column = price(np.maximum(duals, 0), sizes, capacity).astype(float)
        if duals @ column <= 1 + 1e-7:
            break
        direction = inverse @ column
        up = np.flatnonzero(direction > 1e-9)
        ratio = use[up] / direction[up]
        leave = up[int(ratio.argmin())]
        step = max(0.0, use[leave] / direction[leave])
        use = use - step * direction
        use[leave] = step
        basis[:, leave] = column
        if turn % 50 == 49:
            inverse = np.linalg.inv(basis)
            use = np.maximum(inverse @ demand, 0)
        else:
            row = inverse[leave] / direction[leave]
            inverse -= np.outer(direction, row)
            inverse[leave] = row
    return basis.T.astype(np.int64), np.maximum(use, 0)


def plan(histogram: dict[int, tuple[int, int]], length: int = LENGTH, step: int = STEP):
    """Patterns and whole numbers of copies for classes ``c`` with (documents, ids) each.

    A share of every pattern's copies is given up, so that about as many ids stay free
    for filling as the places in the remaining sequences need."""
    sizes = np.array(sorted(histogram), np.int64)
    if not len(sizes):
        return sizes, np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
    demand = np.array([histogram[int(c)][0] for c in sizes], float)
    ids = sum(histogram[int(c)][1] for c in sizes)
    rows, use = patterns(sizes, demand, length // step)
    mean = np.array([histogram[int(c)][1] / histogram[int(c)][0] for c in sizes])
    room = float(np.maximum(length - rows @ mean, 0) @ use)
    share = min(0.5, 1.2 * room / max(ids, 1) + 0.002)
    copies = np.floor(use * (1 - share)).astype(np.int64)
    keep = copies > 0
    return sizes, rows[keep], copies[keep]


def ranked(df: DataFrame, group: str, order: str, salts: int = SALTS) -> DataFrame:
    """``df`` with ``rank``, 0, 1, ... within each group, without a group in one task: rows are
    ranked per salt and the salts' counts, of bounded number, give the offsets."""
    df = df.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)))
    counts = df.groupBy(group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(group, "_salt").orderBy(order)) - 1
    return (df.withColumn("_local", local).join(counts, [group, "_salt"])
            .withColumn("rank", F.col("_before") + F.col("_local")).drop("_salt", "_local", "_before"))


def running(df: DataFrame, index: str, value: str, out: str, width: int = 4096) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows of smaller ``index`` (dense numbers)."""
    df = df.withColumn("_cell", F.floor(F.col(index) / width))
    cells = df.groupBy("_cell").agg(F.sum(value).alias("_sum")).withColumn("_high", F.floor(F.col("_cell") / width))
    highs = cells.groupBy("_high").agg(F.sum("_sum").alias("_hsum"))
    prior = lambda *c: Window.partitionBy(*c[:-1]).orderBy(c[-1]).rowsBetween(
        Window.unboundedPreceding, -1)
    highs = highs.select("_high", F.coalesce(F.sum("_hsum").over(prior("_high")), F.lit(0)).alias("_hb"))
    cells = cells.join(highs, "_high").select(
        "_cell", (F.col("_hb") + F.coalesce(F.sum("_sum").over(prior("_high", "_cell")), F.lit(0))).alias("_b"))
    return (df.join(cells, "_cell")
            .withColumn(out, F.col("_b") + F.coalesce(F.sum(value).over(prior("_cell", index)), F.lit(0)))
            .drop("_cell", "_b"))


def _places(spark, sizes, rows, copies) -> DataFrame:
    """Per class: the ranks at which a pattern's places begin, places per copy, first sequence."""
    base = np.concatenate([[0], np.cumsum(copies)])
    table = []
    for j, c in enumerate(sizes.tolist()):
        at, spots = 0, []
        for p in np.flatnonzero(rows[:, j]).tolist():
            n = int(rows[p, j] * copies[p])
            spots.append((at, at + n, int(rows[p, j]), int(base[p])))
            at += n
        table.append((c, spots))
    return spark.createDataFrame(
        table, "class long, spots array<struct<lo:long,hi:long,per:long,base:long>>")


def packed(cut: DataFrame, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """Assign pieces to sequences: ``cut`` (see ``pieces``) with ``sequence_id`` and ``offset``.

    A piece that fills a gap is cut further; its ids and checksum are those of its part."""
    spark = cut.sparkSession
    meta = cut.select("doc_id", "piece", "start", "length", "doc_tokens", "ids_crc32")
    whole = meta.filter(F.col("length") == length).withColumn("class", F.lit(0))
    rests = meta.filter(F.col("length") < length).withColumn(
        "class", F.ceil(F.col("length") / step).cast("long"))
    found = rests.groupBy("class").agg(F.count(F.lit(1)), F.sum("length")).collect()
    sizes, rows, copies = plan({r[0]: (r[1], r[2]) for r in found}, length, step)
    planned = int(copies.sum()) if len(copies) else 0

    rest = ranked(rests, "class", "piece")
    if planned:
        rest = rest.join(F.broadcast(_places(spark, sizes, rows, copies)), "class", "left")
        spot = F.get(F.filter("spots", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"])), F.lit(0))
        rest = rest.withColumn("spot", spot).drop("spots")
        rest = rest.withColumn("sequence_id", F.col("spot.base") + F.floor(
            (F.col("rank") - F.col("spot.lo")) / F.col("spot.per"))).drop("spot", "rank")
    else:
        rest = rest.drop("rank").withColumn("sequence_id", F.lit(None).cast("long"))
    rest = written(rest, "placed")
    placed = rest.filter(F.col("sequence_id").isNotNull())
    each = Window.partitionBy("sequence_id").orderBy("class", "piece")
    placed = placed.withColumn("offset", F.coalesce(
        F.sum("length").over(each.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    # places that remain, laid end to end: [lo, lo + room) of the free ids go to each
    used = placed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    used = used.withColumn("room", length - F.col("used"))
    rooms = running(used.filter(F.col("room") > 0), "sequence_id", "room", "lo")
    free = ranked(rest.filter(F.col("sequence_id").isNull()).drop("sequence_id").withColumn("one", F.lit(1)),
                  "one", "piece").drop("one")
    free = written(running(free, "rank", "length", "lo"), "free")
    totals = free.agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0]
    wanted = used.agg(F.coalesce(F.sum("room"), F.lit(0))).head()[0]
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / length), F.floor((hi - 1) / length)))
    gap = rooms.select("sequence_id", "used", "lo", (F.col("lo") + F.col("room")).alias("hi"))
    gap = gap.select("*", cells(F.col("lo"), F.col("hi")).alias("cell"))
    stream = free.select("doc_id", "piece", "start", "doc_tokens", "length", F.col("lo").alias("flo"),
                         (F.col("lo") + F.col("length")).alias("fhi"))
    stream = stream.select("*", cells(F.col("flo"), F.col("fhi")).alias("cell"))
    # beyond the places the free ids are cut into sequences of their own
    rest_ids = max(0, totals - wanted)
    n_full, tail = divmod(rest_ids, length)
    at, own = wanted + n_full * length, []
    for bit in range(length.bit_length() - 1, -1, -1):
        if tail >> bit & 1:
            own.append((planned + n_full + len(own), 0, at, at + (1 << bit)))
            at += 1 << bit
    schema = "sequence_id long, used long, lo long, hi long"
    fresh = spark.range(n_full).select(
        (F.col("id") + planned).alias("sequence_id"), F.lit(0).cast("long").alias("used"),
        (F.col("id") * length + wanted).alias("lo"), ((F.col("id") + 1) * length + wanted).alias("hi"))
    fresh = fresh.unionByName(spark.createDataFrame(own, schema))
    gap = gap.unionByName(fresh.select("*", cells(F.col("lo"), F.col("hi")).alias("cell")))
    lo, hi = F.greatest("lo", "flo", F.col("cell") * length), F.least("hi", "fhi", (F.col("cell") + 1) * length)
    parts = stream.join(gap, "cell").filter((F.col("lo") < F.col("fhi")) & (F.col("flo") < F.col("hi")))
    parts = parts.withColumn("a", lo).withColumn("b", hi).filter(F.col("a") < F.col("b"))
    # parts that meet at the border of two cells are one
    parts = parts.groupBy("doc_id", "piece", "start", "doc_tokens", "sequence_id", "used", "lo", "flo").agg(
        F.min("a").alias("a"), F.max("b").alias("b"))
    parts = parts.select("doc_id", "piece", "start", "doc_tokens", "sequence_id",
                         (F.col("used") + F.col("a") - F.col("lo")).alias("offset"),
                         (F.col("a") - F.col("flo")).alias("skip"), (F.col("b") - F.col("a")).alias("length"))
    ids = cut.select("piece", "ids")
    filled = parts.join(ids, "piece").withColumn(
        "ids", F.expr("substring(ids, int(4 * skip + 1), int(4 * length))"))
    filled = filled.select(
        "doc_id", "piece", (F.col("start") + F.col("skip")).alias("start"), "length", "doc_tokens",
        F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")

    next_id = planned + n_full + len(own)
    whole = ranked(whole, "class", "piece").withColumn("sequence_id", F.col("rank") + next_id)
    whole = whole.withColumn("offset", F.lit(0).cast("long"))
    names = ["doc_id", "piece", "start", "length", "doc_tokens", "ids_crc32", "sequence_id", "offset"]
    return placed.select(*names).unionByName(whole.select(*names)).unionByName(filled.select(*names))


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with sequence and offset."""
    return packed(written(pieces(df, path, key, text), "pieces"))


def sequences(cut: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ids (32-bit, little-endian) and their number."""
    first = cut.select("piece", F.col("start").alias("at"), "ids")
    part = placed.join(first, "piece").withColumn(
        "ids", F.expr("substring(ids, int(4 * (start - at) + 1), int(4 * length))"))
    return part.groupBy("sequence_id").agg(
        F.sum("length").alias("n_ids"),
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")).select(
        "sequence_id", "n_ids", F.expr("aggregate(p, cast('' AS binary), (a, x) -> concat(a, x.ids))").alias("ids"))
