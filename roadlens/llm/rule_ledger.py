"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger row holds the measurements and one
bit per rule that fails. Policies are versioned sets of rules, applied to the ledger later
with a bitwise test, and ablations (what would a policy keep without one of its rules, what
does a rule alone reject) are aggregates over the distinct masks, never a second scan of
the texts.

A null or empty text has zero everywhere and fails ``few_words``. Rows are independent:
repeated rows give repeated ledger rows, an empty table an empty ledger. Columns of the
input that clash with the ledger's own are replaced; others are kept by ``with_ledger``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens.llm import textscan as ts
from roadlens.llm.storage import let_workers_import

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
            "n_upper", "n_letters", "n_stutters")

# Rules in bit order. New rules go to the end, so that stored masks keep their meaning.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 30 * n_words"),
    ("shouting", "n_letters >= 20 AND 10 * n_upper > 4 * n_letters"),
    ("stutter", "10 * n_stutters > 3 * n_words"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version and the rules it enforces."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
STANDARD = Policy("2", tuple(BITS))

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_POINT = np.ones(256, np.int64)
_POINT[0x80:0xC0] = 0
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LETTER = _UPPER.copy()
_LETTER[97:123] = 1


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(texts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where the same hash occurs more than once in the text."""
    order = np.lexsort((hashes, texts))
    t, h = texts[order], hashes[order]
    same = (t[1:] == t[:-1]) & (h[1:] == h[:-1])
    out = np.zeros(len(texts), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Measurements of some texts, given as bytes and offsets."""
    n = len(offsets) - 1
    starts, ends, texts = ts.words(data, offsets)
    covered = np.zeros(len(starts) + 1, np.int64)
    hashes = ts.span_hashes(data, starts, ends)
    places, values = ts.grams(hashes, texts, WINDOW)
    stutters = (hashes[1:] == hashes[:-1]) & (texts[1:] == texts[:-1])
    twice = places[_repeated(texts[places], values)]
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + WINDOW, -1)
    repeated = np.cumsum(covered)[:-1] > 0

    first, last, owner = ts.spans(data != 10, offsets)
    lines = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    line_hash = ts.span_hashes(data, first[lines], last[lines])
    owner = owner[lines]
    order = np.lexsort((line_hash, owner))
    again = (owner[order][1:] == owner[order][:-1]) & (line_hash[order][1:] == line_hash[order][:-1])
    space = ts.SPACE[data]
    return {
        "n_words": np.bincount(texts, minlength=n),
        "word_chars": _sums(_POINT[data] * ~space, offsets),
        "n_symbols": _sums(_SYMBOL[data], offsets),
        "n_lines": np.bincount(owner, minlength=n),
        "n_dup_lines": np.bincount(owner[order][1:][again], minlength=n),
        "n_repeat_words": np.bincount(texts[repeated], minlength=n),
        "n_upper": _sums(_UPPER[data], offsets),
        "n_letters": _sums(_LETTER[data], offsets),
        "n_stutters": np.bincount(texts[1:][stutters], minlength=n),
    }


def with_ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with its measurements and ``failures``, the mask of the rules that fail."""
    let_workers_import(df.sparkSession)
    df = df.drop(*[c for c in df.columns if c in (*MEASURES, "failures") and c != text])
    schema = T.StructType([*df.schema.fields, *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ts.flat(batch.column(batch.schema.get_field_index(text)))
            parts = [measure(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                     for lo, hi in ts.pieces(offsets)]
            found = [pa.array(np.concatenate([p[m] for p in parts]) if parts else [], pa.int64())
                     for m in MEASURES]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found],
                                             names=[*batch.schema.names, *MEASURES])

    bits = [F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0)) for name, rule in RULES]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return df.mapInArrow(scan, schema).withColumn("failures", total.cast("long"))


def ledger(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, measurements and failure mask of every row."""
    found = with_ledger(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text")
    return found.select(F.col("_key").alias(key), *MEASURES, "failures")


def passes(policy: Policy):
    """Column: no rule of the policy fails."""
    return F.col("failures").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: rows that fail it, rows that it alone rejects, and rows the
    policy would keep without it. Masks are counted first; there are at most 2^rules."""
    masks = rows.groupBy(F.col("failures").bitwiseAND(F.lit(policy.mask)).alias("m")).count()
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit"))
                      for r in policy.rules])
    each = masks.select("m", "count", F.explode(rules).alias("r"))
    hit = F.col("m").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("m") == F.col("r.bit")
    kept = (F.col("m") == 0) | alone
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("count")).otherwise(0)).alias("fails"),
        F.sum(F.when(alone, F.col("count")).otherwise(0)).alias("only_this"),
        F.sum(F.when(kept, F.col("count")).otherwise(0)).alias("kept_without"),
        F.bit_or("m").alias("seen_with"),
    )
