"""N-gram Jaccard join: an exact size-aware heavy-light join of shingle sets.

Documents with equal sets are one class from the start. Shingles that occur in a single
class cannot be shared, so a class whose shared shingles are too few for the threshold
links with nothing and leaves at once. The others are ordered by rising frequency, and any
two that link must meet in their first shingles. Classes below a size boundary enumerate the
fixed-size subsets (pairs) of their first shingles; larger ones are found through the inverted
lists of theirs. The boundary is the one with the lowest cost by the frequencies. Candidates
are compared exactly on their shingles.

Inside a list links are sought from central members first; members already connected are not
compared again, so a group of near copies costs about its size, while the components stay
exact: what remains unconnected is compared in full.

A null text or one without words has the empty set and links with nothing. Rows are
documents: repeated rows are equal documents. A component is named by the smallest id it
holds. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm import textscan as ts
from roadlens.llm.components import components
from roadlens.llm.storage import let_workers_import, written

SHINGLE, PERCENT = 4, 85
RANGE_BYTES = 16 << 20
SLICES = 4  # of a range, met one after the other
FLUSH = 3_000_000
LOW_BYTES = 6  # of a shingle's hash, sent beside its range
BLOCK = 2000  # members of a bucket that are compared with as many others in one place
SUBSET = 2  # size of the enumerated subsets
LARGEST_SMALL = 96  # sizes above are never enumerated
CANDIDATE_COST = 4.0  # of comparing a candidate, in rows written


def _classes(owners: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Set size and class of each text: a 64-bit digest of its set."""
    sizes = np.bincount(owners, minlength=n)
    ends = np.cumsum(sizes)
    total = np.zeros((2, len(values) + 1), ts.U64)
    np.cumsum(ts.mix(values ^ ts.U64(0x9FB21C651E98DF25)), out=total[0, 1:])
    np.cumsum(ts.mix(values + ts.U64(0xD1B54A32D192ED03)), out=total[1, 1:])
    sums = total[:, ends] - total[:, ends - sizes]
    return sizes, ts.mix(sums[0] ^ ts.mix(sums[1] + sizes.astype(ts.U64))).view(np.int64)


def _sets(column, shingle: int):
    data, offsets = ts.flat(column)
    for lo, hi in ts.pieces(offsets):
        owners, values = ts.shingle_sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], shingle)
        yield (*_classes(owners, values, hi - lo), values)


def signatures(df: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """Key, set size and class of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(s, c) for s, c, _ in _sets(batch.column(1), shingle)]
            sizes, classes = (np.concatenate(x) for x in zip(*found, strict=True)) if found else ([], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64())],
                names=["_key", "n_shingles", "class"])

    let_workers_import(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        run, f"_key {kind}, n_shingles long, class long")


def shared_shingles(df: DataFrame, text: str, shingle: int = SHINGLE, bits: int | None = None) -> DataFrame:
    """``(class, n, token, df)`` of every shingle that at least two classes hold.

    Tasks send shingle hashes in packed arrays, one per range of hashes; a range is small
    whatever the input's size, and a class of any number of copies is sent once a task. A
    range meets in slices, which take less memory than smaller ranges and name a class once
    for all of them. A token has the bits of its range and 48 more, all 64 from 65,536 ranges on."""
    if bits is None:
        size = df.agg(F.sum(F.octet_length(text))).head()[0] or 0
        bits = max(4, int(size // RANGE_BYTES).bit_length())
    low_bits = min(48, 64 - bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            sizes, classes, values = (np.concatenate(x) for x in zip(*held, strict=True))
            first = np.zeros(len(classes), bool)
            first[np.unique(classes, return_index=True)[1]] = True
            keep = first & (sizes > 1)
            values = values[np.repeat(keep, sizes)]
            sizes, classes = sizes[keep], classes[keep]
            owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            part = (values >> ts.U64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
            order = np.argsort(part, kind="stable")
            part, owner = part[order], owner[order]
            low = (values[order] >> ts.U64(64 - bits - low_bits)) & ts.U64((1 << low_bits) - 1)
            low = np.ascontiguousarray(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :LOW_BYTES])
            cut = np.flatnonzero(np.diff(part)) + 1
            rows = [[], [], [], [], []]
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(part)], strict=True):
                if a == b:
                    continue
                own = owner[a:b]
                begin = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
                runs = np.diff(np.append(begin, b - a)).astype(np.int32)
                at = own[begin]
                for column, x in zip(rows, (int(part[a]), classes[at].tobytes(), ts.planes(sizes[at].astype(np.int32)),
                                            ts.planes(runs), low[a:b].tobytes()), strict=True):
                    column.append(x)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), *(pa.array(x, pa.binary()) for x in rows[1:])],
                names=["part", "classes", "sizes", "runs", "hashes"])

        waiting = 0
        for batch in batches:
            for found in _sets(batch.column(0), shingle):
                held.append(found)
                waiting += len(found[2])
                if waiting >= FLUSH:
                    yield flush()
                    waiting = 0
        if held:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        def buffers(name):
            return [x.as_buffer() for x in table.column(name)]

        def numbers(name):
            return np.concatenate([ts.unplaned(x, np.int32) for x in buffers(name)])

        high = np.array(table.column("part")[0].as_py() << low_bits, np.uint64).view(np.int64)
        names, at, inverse = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in buffers("classes")]),
                                       return_index=True, return_inverse=True)
        sizes, owner = numbers("sizes")[at], np.repeat(inverse.astype(np.int32), numbers("runs"))
        sent = np.concatenate([np.frombuffer(x, np.uint8) for x in buffers("hashes")]).reshape(-1, LOW_BYTES)
        slices = sent[:, 0] % SLICES
        found = []
        for k in range(SLICES):
            place = np.flatnonzero(slices == k)
            low = np.zeros((len(place), 8), np.uint8)
            low[:, :LOW_BYTES] = sent[place]
            token, who = low.view("<u8").ravel(), owner[place]
            order = np.lexsort((who, token))
            token, who = token[order], who[order]
            del place, low, order
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (who[1:] != who[:-1])
            token, who = token[new].astype(np.int64), who[new]
            begin = np.flatnonzero(np.append(True, token[1:] != token[:-1])[:len(token)])
            count = np.diff(np.append(begin, len(token)))
            df_ = np.repeat(count, count)
            keep = df_ > 1
            found.append((who[keep], token[keep] | high, df_[keep]))
        who, token, df_ = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"class": names[who], "n": sizes[who].astype(np.int64), "token": token,
                         "df": df_.astype(np.int64)})

    let_workers_import(df.sparkSession)
    sent = df.select(F.col(text).alias("_text")).mapInArrow(
        send, "part long, classes binary, sizes binary, runs binary, hashes binary")
    return sent.groupBy("part").applyInArrow(meet, "class long, n long, token long, df long")


def _need(n: str, percent: int) -> str:
    """Smallest number of shingles that a set of size ``n`` must share to link."""
    return f"CAST(ceil({n} * {percent} / 100.0) AS BIGINT)"


def boundary(sets: DataFrame, percent: int) -> int:
    """The set size from which inverted lists are cheaper than subsets, by the sum of rows
    written and candidates met. Sizes are counted up to ``LARGEST_SMALL``, so the table is small."""
    cost = sets.select(
        F.least("n", F.lit(LARGEST_SMALL)).alias("n"),
        F.expr(f"""aggregate(slice(shared, 1, first), 0D, (a, s) -> a + 1 + {CANDIDATE_COST} * (s.df - 1))""").alias("lists"),
        F.expr("first + 1").alias("q"),
        F.expr("shared[least(first, size(shared) - 1)].df").alias("last"))
    pairs = F.col("q") * (F.col("q") - 1) / 2
    rows = cost.groupBy("n").agg(
        F.sum("lists"), F.sum(pairs * (1 + CANDIDATE_COST / 4 * (F.col("last") - 1)))).collect()
    best, at = None, 2
    for x in range(2, LARGEST_SMALL + 1):
        total = sum(r[2] for r in rows if r[0] < x) + sum(r[1] for r in rows if r[0] * 100 >= percent * x)
        if best is None or total < best:
            best, at = total, x
    return at


def meetings(sets: DataFrame, percent: int) -> DataFrame:
    """``(bucket, class, n, central, most)``: buckets in which any two classes that link meet.

    ``most`` bounds what a class can share with others whose first common shingles are the
    bucket's: those and the later ones in order. A pair that links passes it in some bucket."""
    x = boundary(sets, percent)
    base = sets.select("class", "n", "central", "shared", "first")
    lists = base.filter(F.col("n") * 100 >= percent * x).select("class", "n", "central", F.explode(F.expr(
        "transform(slice(shared, 1, first), (s, i) -> struct(s.token AS bucket, size(shared) - i AS most))")).alias("m"))
    small = base.filter(F.col("n") < x).withColumn("head", F.expr(
        f"transform(slice(shared, 1, first + {SUBSET - 1}), s -> s.token)"))
    subsets = small.select("class", "n", "central", F.explode(F.expr(
        """flatten(transform(head, (t, i) -> transform(slice(head, i + 2, size(head)), (u, j) -> struct(
               xxhash64(least(t, u), greatest(t, u)) AS bucket, size(shared) - i - j AS most))))""")).alias("m"))
    rows = lists.unionByName(subsets).select("class", "n", "central", "m.bucket", "m.most")
    # a member must be able to link with the smallest of its bucket, or it links with none
    common = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_m"), F.min("n").alias("_least")).filter("_m > 1")
    able = rows.join(common, "bucket").filter(f"{100 + percent} * most >= {percent} * (n + _least)")
    return able.drop("_m", "_least")


def _can_link(a: str, b: str, percent: int) -> str:
    """Sizes and bounds of two members of a bucket allow a link."""
    return f"{100 + percent} * least({a}.most, {b}.most) >= {percent} * ({a}.n + {b}.n)"


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the threshold."""
    tokens = sets.select("class", "n", F.expr("transform(shared, s -> s.token)").alias("tokens"))
    a = tokens.toDF("a", "n_a", "t_a")
    b = tokens.toDF("b", "n_b", "t_b")
    both = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("t_a", "t_b")))
    return both.filter(f"100 * common >= {percent} * (n_a + n_b - common)").select("a", "b")


def class_components(sets: DataFrame, percent: int) -> DataFrame | None:
    """``(node, component)`` of the classes that link with another one."""
    spark = sets.sparkSession
    open_rows = written(meetings(sets, percent), "buckets")
    open_rows = open_rows.withColumn("component", F.col("class"))
    links = spark.createDataFrame([], "a long, b long")
    labels = None
    size = open_rows.count()
    while size:
        member = F.struct("central", "class", "component", "n", "most")
        centre = open_rows.groupBy("bucket").agg(
            F.max(member).alias("p"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        centre = centre.filter("lo <> hi").select("bucket", "p")
        pairs = open_rows.alias("o").join(centre, "bucket").filter(
            f"o.component <> p.component AND {_can_link('o', 'p', percent)}")
        pairs = pairs.select(F.col("p.class").alias("a"), F.col("class").alias("b")).distinct()
        links = links.unionByName(_linked(pairs, sets, percent))
        links = written(links, "found")
        labels = components(links)
        # a central member has met all others of its bucket: it can go
        now = open_rows.drop("component").join(centre, "bucket").filter("class <> p.class").drop("p")
        now = now.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn(
            "component", F.coalesce("component", "class"))
        mixed = now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        now = written(now.join(mixed.filter("lo <> hi").select("bucket"), "bucket", "left_semi"), "open")
        left = now.count()
        if left * 10 > size * 9:  # little gained: the rest have few links, compare them in full
            links = written(links.unionByName(_rest(now, sets, percent)), "found")
            return components(links)
        open_rows, size = now, left
    return labels


def _rest(rows: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links among members of a bucket that are in different components.

    The members of a bucket are dealt into blocks, and every two blocks meet in a place of
    their own, so that no task compares more than about ``block`` by ``block`` members."""
    blocks = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    dealt = rows.join(blocks, "bucket").withColumn("_own", F.pmod(F.xxhash64("class"), F.col("_blocks")).cast("int"))
    left = dealt.withColumn("_other", F.explode(F.sequence("_own", F.col("_blocks") - 1)))
    right = dealt.withColumnRenamed("_own", "_other").withColumn("_own", F.explode(F.sequence(F.lit(0), F.col("_other"))))
    same = F.expr("a.bucket = b.bucket AND a._own = b._own AND a._other = b._other")
    pairs = left.alias("a").join(right.alias("b"), same & F.expr(
        f"(a._own < a._other OR a.class < b.class) AND a.component <> b.component AND {_can_link('a', 'b', percent)}"))
    pairs = pairs.select(F.least("a.class", "b.class").alias("a"), F.greatest("a.class", "b.class").alias("b"))
    return _linked(pairs.distinct(), sets, percent)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text",
                    shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Key, ``n_shingles`` and ``component_id`` of every row. Two rows link when
    100 * intersection >= percent * union of their sets of ``shingle``-word shingles."""
    rows = written(signatures(df, key, text, shingle), "signatures")
    need = _need("n", percent)
    # dealt as rows, whose room does not rise as partial lists would get shorter with more tasks
    sets = shared_shingles(df, text, shingle).repartition("class").groupBy("class", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    sets = sets.filter(f"size(shared) >= {need}").withColumn(
        "first", F.expr(f"CAST(size(shared) - {need} + 1 AS INT)"))
    sets = sets.withColumn("central", F.expr("aggregate(shared, 0L, (a, s) -> a + s.df) / n"))
    labels = class_components(written(sets, "sets"), percent)
    named = rows.withColumn("component", F.col("class"))
    if labels is not None:
        named = rows.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn(
            "component", F.coalesce("component", "class"))
    named = named.filter("n_shingles > 0")
    least = named.groupBy("component").agg(F.min("_key").alias("component_id"))
    out = named.join(least, "component").select("_key", "n_shingles", "component_id")
    alone = rows.filter("n_shingles = 0").select("_key", "n_shingles", F.col("_key").alias("component_id"))
    return out.unionByName(alone).withColumnRenamed("_key", key)
