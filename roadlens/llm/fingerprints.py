"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame functions only.

A fingerprint holds the ``k`` smallest 48-bit hashes of a text's distinct shingles of five
words (all words, if fewer). A text with at most ``k`` shingles is held whole, so its
estimates are exact. Sketches of parts merge into the sketch of the whole.

A null text is an empty one. Texts without words have the empty sketch, which is like
another empty sketch (1) and unlike any other (0). Equal texts have equal fingerprints."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
SHINGLE = 5
HASH_BITS = 48
ROWS_PER_BUCKET = 2000
NONE = "cast(array() as array<bigint>)"


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with column ``out``: the sorted ``k`` smallest shingle hashes of ``text``."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+")
    words = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))
    # each name is used several times below, so the optimizer keeps it a column of its own
    df = df.withColumn("_words", words)
    each = ", ".join(f"get(_words, i + {j})" for j in range(shingle))
    hashes = F.expr(f"""CASE WHEN size(_words) = 0 THEN {NONE}
        WHEN size(_words) < {shingle} THEN array(shiftrightunsigned(xxhash64(_words, size(_words)), {64 - HASH_BITS}))
        ELSE transform(sequence(0, size(_words) - {shingle}),
                       i -> shiftrightunsigned(xxhash64({each}), {64 - HASH_BITS})) END""")
    return df.withColumn(out, F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)).drop("_words")


def as_text(sketch: str | Column) -> Column:
    """A sketch as lower-case hex, 12 digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), HASH_BITS // 4, "0"))), "")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sets."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: str, b: str, k: int = K) -> Column:
    """Estimated intersection over union, 0 to 1."""
    a, b = F.col(a), F.col(b)
    union = merged(a, b, k)
    common = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
            .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
            .otherwise(common / F.size(union)))


def distinct_count(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    space = float(1 << HASH_BITS)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(
        (k - 1) * space / F.get(sketch, F.lit(k - 1)))


def containment(a: str, b: str, k: int = K) -> Column:
    """Estimated share of the first set that the second holds, 0 to 1."""
    first = distinct_count(F.col(a), k)
    union = distinct_count(merged(F.col(a), F.col(b), k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), resemblance(a, b, k) * union / first))


def merge_groups(df: DataFrame, key: str, sketch: str, k: int = K, salts: int = 64) -> DataFrame:
    """One sketch per key. Hashes are made distinct and cut to ``k`` per salt before they meet,
    so a key with any share of the rows is spread and a task holds ``salts * k`` of its hashes."""
    hashes = df.select(F.col(key).alias("_key"), F.explode_outer(sketch).alias("h")).distinct()
    salted = hashes.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(salts)))
    lowest = salted.withColumn("r", F.row_number().over(Window.partitionBy("_key", "salt").orderBy("h")))
    lowest = lowest.filter(F.col("r") <= k)
    return lowest.groupBy(F.col("_key").alias(key)).agg(
        F.slice(F.array_sort(F.collect_list("h")), 1, k).alias(sketch))


def _buckets(df: DataFrame, key: str) -> Column:
    """A range of keys for each row, of about ``ROWS_PER_BUCKET`` rows. The borders are
    approximate quantiles in two levels, so that a row is compared with few of them."""
    rows = df.agg(F.count(F.lit(1))).head()[0]
    side = max(2, min(300, math.isqrt(rows // ROWS_PER_BUCKET) + 1))
    n = side * side
    borders = df.agg(F.percentile_approx(key, [i / n for i in range(n)], max(10000, 10 * n))).head()[0]
    if not borders:
        return F.lit(0)
    fine = [borders[i:i + side] for i in range(0, n, side)]
    lit = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    first = F.size(F.filter(lit([f[0] for f in fine]), lambda b: b <= F.col(key)))
    second = F.size(F.filter(F.get(F.array(*[lit(f) for f in fine]), F.greatest(first - 1, F.lit(0))),
                             lambda b: b <= F.col(key)))
    return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(first * (n + 1) + second)


def with_next(df: DataFrame, key: str, columns: dict[str, str], derive=lambda df: df) -> DataFrame:
    """``derive(df)`` with values of the next row by descending key (after the last: the first).

    Null keys come last; rows of one key follow their first listed column. Rows are dealt
    by ranges of the key, and the first row of each range is passed to the range before."""
    tie = next(iter(columns))
    df = df.withColumn("_bucket", _buckets(df, key))
    tops = df.groupBy("_bucket").agg(F.max(key).alias("_top"))
    order = Window.orderBy(F.col("_bucket").desc())  # one row a range
    last = Window.orderBy(F.col("_bucket"))
    follows = tops.select(
        F.col("_bucket").alias("_after"),
        F.coalesce(F.lead("_bucket").over(order), F.last("_bucket").over(
            last.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_bucket"))
    top_keys = tops.select("_bucket", F.col("_top"))
    firsts = df.join(F.broadcast(top_keys), "_bucket").filter(F.col(key).eqNullSafe(F.col("_top")))
    df, firsts = derive(df), derive(firsts)
    firsts = firsts.groupBy("_bucket").agg(F.min(F.struct(*columns)).alias("_first"))
    firsts = firsts.join(follows, "_bucket").select(F.col("_after").alias("_bucket"), "_first")
    within = Window.partitionBy("_bucket").orderBy(F.col(key).desc_nulls_last(), F.col(tie))
    row = df.withColumn("_next", F.lead(F.struct(*columns)).over(within)).join(firsts, "_bucket", "left")
    row = row.withColumn("_next", F.coalesce("_next", "_first"))
    return row.select(*[c for c in df.columns if c != "_bucket"],
                      *[F.col("_next")[c].alias(out) for c, out in columns.items()])


def edited_text(text: str, following: str) -> Column:
    """The last third of ``text`` replaced by the first as many code points of ``following``."""
    third = f"CAST(floor(length({text}) / 3) AS INT)"
    return F.expr(f"concat(substring({text}, 1, length({text}) - {third}), substring({following}, 1, {third}))")
