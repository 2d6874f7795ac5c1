"""The corpus pipeline: quality rules, near duplicates, repeated passages, personal data,
packing.

Every stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the
columns of ``documents``. Repeated rows count as equal documents, of which one stays.
Nulls, empty texts and empty tables are treated as the operators' docstrings say; extra
columns of the documents are carried through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm import cutting_stock, jaccard_join, longest_previous, personal_data, rule_ledger
from roadlens.llm.registry import tokenizer_path
from roadlens.llm.storage import let_workers_import, written

SHINGLE, PERCENT = 5, 80  # near duplicates: five words, similarity of 0.8 or more


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with the columns in order and ``n_chars`` of the present text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the standard policy."""
    let_workers_import(spark)
    kept = rule_ledger.with_ledger(docs).filter(rule_ledger.passes(rule_ledger.STANDARD))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    let_workers_import(spark)
    groups = jaccard_join.near_duplicates(docs, shingle=SHINGLE, percent=PERCENT)
    first = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("_first")).distinct()
    kept = docs.join(first, docs["doc_id"].eqNullSafe(first["_first"]), "left_semi")
    return kept.withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_hash"]).drop("_hash")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has."""
    let_workers_import(spark)
    kept = longest_previous.without_repeats(docs, as_text=True).withColumnRenamed("kept", "text")
    return _recounted(kept, docs.columns)


def personal_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    let_workers_import(spark)
    return _recounted(personal_data.redacted(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids."""
    let_workers_import(spark)
    placed = cutting_stock.pack(docs, tokenizer_path("word_bpe_49k.json"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("personal_data", personal_spans),
    ("packing", packing),
]
ORACLE_SQL = None  # components, suffixes and packing are tested against brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
